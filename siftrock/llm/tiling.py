"""Benchmark decontamination by greedy string tiling with running Karp-Rabin hashes.

The benchmark is a stated query set that goes over all documents in blocks: each block (at most about
``block_chars`` of text) is indexed by the rolling hashes of its ``min_match``-token windows and broadcast, so a task holds one block,
whatever the benchmark's size. The distinct windows of a document are looked up in the index, which bounds how much of each item it can
cover; items within reach are tiled. Greedy tiling marks the longest unmarked match (ties: first in the item, then in the
document) and goes on with what is unmarked: the longest length is found by halving, as hashes of windows of any length come from running
sums, and all tiles of one length are marked in one pass over item and document, so no pairs of positions are listed. As tiles may lie
in any order, reordered passages count in full. A document holds an item if tiles cover at least ``threshold`` of the item's tokens.
Tokens are runs of letters, digits and underscores in lower case.

Defined results: null and empty texts hold nothing; items without tokens are never held; an item shorter than
``min_match`` must occur whole. Rows that repeat are judged each. An item id that repeats gives a row for each of
its texts. Whole texts are scanned.
"""

from __future__ import annotations

import re
from collections import defaultdict, deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import sliced, written

WORD = re.compile(r"\w+")
BASE = 0x9E3779B97F4A7C15

FOUND = "doc_id long, item_id long, covered int, item_tokens int, coverage double, tiles int, longest int"


def tokens(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n + 1, np.uint64(base))
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Running:
    """Karp-Rabin hashes (modulo 2**64) of the windows of any length of token ids, from running sums."""

    def __init__(self, ids: np.ndarray):
        v = ids.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(0x632BE59BD9B4E019)
        v ^= v >> np.uint64(29)
        v *= np.uint64(0xBF58476D1CE4E5B9)
        self.n = len(v)
        self.up = _powers(self.n, BASE)  # window k is sum of v[k + i] * BASE**-i
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(v * _powers(self.n, pow(BASE, -1, 1 << 64))[: self.n], dtype=np.uint64)])

    def windows(self, k: int, at: np.ndarray | None = None) -> np.ndarray:
        """The hashes of the windows of k ids, of all or of those that begin at ``at``."""
        at = np.arange(max(0, self.n - k + 1)) if at is None else at
        return (self.sums[at + k] - self.sums[at]) * self.up[at]


class Index:
    """A block of items: their vocabulary, tokens, and where each window hash occurs."""

    def __init__(self, items: list[tuple[int, str | None]], min_match: int):
        self.k = min_match
        self.vocabulary: dict[str, int] = {}
        self.ids, self.items = [], []
        for item_id, text in items:
            words = tokens(text)
            if words:
                self.ids.append(item_id)
                self.items.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], np.int64))
        self.short = [i for i, t in enumerate(self.items) if len(t) < min_match]
        hashes = [Running(t).windows(min_match) for t in self.items]
        where = [np.stack([np.full(len(h), i), np.arange(len(h))], 1) for i, h in enumerate(hashes)]
        flat = np.concatenate([*hashes, np.zeros(0, np.uint64)])
        order = np.argsort(flat, kind="stable")
        self.hashes = flat[order]
        self.where = np.concatenate([*where, np.zeros((0, 2), np.int64)]).astype(np.int64)[order]

    def encode(self, text: str | None) -> np.ndarray:
        """Token ids; 0 for a word that no item has."""
        words = tokens(text)
        get = self.vocabulary.get
        return np.fromiter((get(w, 0) for w in words), np.int64, len(words))

    def within_reach(self, doc: np.ndarray, threshold: float) -> list[int]:
        """The items that tiles of ``doc`` may cover enough of: those whose windows that it has cover enough."""
        out = []
        if len(doc) >= self.k and len(self.hashes):
            known = np.concatenate([[0], np.cumsum(doc == 0)])
            at = np.flatnonzero(known[self.k :] == known[: -self.k])
            if len(at):
                h = np.unique(Running(doc).windows(self.k, at))
                low, high = np.searchsorted(self.hashes, h, "left"), np.searchsorted(self.hashes, h, "right")
                counts = (high - low)[high > low]
                rows = np.repeat(low[high > low] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
                where = self.where[rows]
                where = where[np.argsort(where[:, 0], kind="stable")]
                for part in np.split(where, np.flatnonzero(np.diff(where[:, 0])) + 1):
                    if len(part):
                        item = int(part[0, 0])
                        edges = np.zeros(len(self.items[item]) + 1, np.int64)
                        np.add.at(edges, part[:, 1], 1)
                        np.add.at(edges, part[:, 1] + self.k, -1)
                        if np.count_nonzero(np.cumsum(edges)) >= threshold * len(self.items[item]):
                            out.append(item)
        return sorted(out + [i for i in self.short if len(doc) >= len(self.items[i])])


def tile(item: np.ndarray, doc: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (length, item position, document position) of at least k equal tokens."""
    sides = [(ids, Running(ids), np.zeros(len(ids), bool)) for ids in (item, doc)]

    def free(side: int, n: int) -> np.ndarray:
        """Where unmarked windows of n tokens begin."""
        marked = np.concatenate([[0], np.cumsum(sides[side][2])])
        return np.flatnonzero(marked[n:] == marked[:-n]) if n < len(marked) else np.zeros(0, np.int64)

    def common(n: int):
        t, p = free(0, n), free(1, n)
        ht, hp = sides[0][1].windows(n, t), sides[1][1].windows(n, p)
        return t[np.isin(ht, hp)], p[np.isin(hp, ht)]

    tiles, top = [], min(len(item), len(doc))
    while top >= k:
        if not len(common(k)[0]):
            break
        low, high = k, top  # a match of n tokens holds one of n - 1
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if len(common(middle)[0]) else (low, middle - 1)
        starts, ends = common(low)
        places = defaultdict(deque)
        for h, p in zip(sides[1][1].windows(low, ends).tolist(), ends.tolist(), strict=True):
            places[h].append(p)
        in_item, in_doc = sides[0][2], sides[1][2]
        for h, t in zip(sides[0][1].windows(low, starts).tolist(), starts.tolist(), strict=True):
            some = places[h]
            if in_item[t : t + low].any():
                continue
            while some and in_doc[some[0] : some[0] + low].any():
                some.popleft()  # marked for good
            if some and np.array_equal(item[t : t + low], doc[some[0] : some[0] + low]):
                p = some.popleft()
                tiles.append((low, t, p))
                in_item[t : t + low], in_doc[p : p + low] = True, True
        if in_item.all():
            break
        top = low - 1
    return tiles


def held_items(index: Index, text: str | None, threshold: float) -> list[tuple[int, int, int, float, int, int]]:
    """(item number, covered, item tokens, coverage, tiles, longest tile) of the items that a text holds."""
    out = []
    doc = index.encode(text)
    for i in index.within_reach(doc, threshold):
        item = index.items[i]
        n = len(item)
        tiles = tile(item, doc, min(index.k, n))
        covered = sum(x[0] for x in tiles)
        if tiles and covered >= threshold * n:
            out.append((i, covered, n, covered / n, len(tiles), max(x[0] for x in tiles)))
    return out


def blocks(benchmark: DataFrame, *, min_match: int, block_chars: int, item_id: str, text: str):
    """Broadcast indexes of the benchmark's blocks, one after another; only one block's texts are on the driver."""
    spark = benchmark.sparkSession
    rows = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text")).where("length(text) > 0")
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // block_chars)
    for i in range(n):
        some = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) if n > 1 else rows
        yield spark.sparkContext.broadcast(Index(sorted((tuple(r) for r in some.collect()), key=lambda r: (r[0] is None, r)), min_match))


def contaminated(docs: DataFrame, benchmark: DataFrame, *, min_match: int = 4, threshold: float = 0.5, block_chars: int = 20_000_000, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id") -> DataFrame:
    """A row for each document and item that it holds."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    out = rows.sparkSession.createDataFrame([], FOUND)
    for index in blocks(benchmark, min_match=min_match, block_chars=block_chars, item_id=item_id, text="text"):

        def scan(batches, index=index):
            names = [c.split()[0] for c in FOUND.split(", ")]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32()]
            for batch in sliced(batches):
                got = [
                    (key, index.value.ids[item], *rest)
                    for key, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True)
                    for item, *rest in held_items(index.value, t, threshold)
                ]
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*got, strict=True), kinds, strict=True)], names)

        out = out.unionAll(rows.mapInArrow(scan, FOUND))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, min_match: int = 4, threshold: float = 0.5, block_chars: int = 20_000_000, text: str = "text", item_id: str = "item_id") -> DataFrame:
    """``docs`` without the rows that hold an item: a filter within each task, without join or shuffle; a written table between blocks."""
    more = False
    for index in blocks(benchmark, min_match=min_match, block_chars=block_chars, item_id=item_id, text="text"):

        def keep(batches, index=index):
            for batch in sliced(batches):
                clean = [not held_items(index.value, t, threshold) for t in batch.column(text).to_pylist()]
                yield batch.filter(pa.array(clean, pa.bool_()))

        if more:  # a task is to hold one index at a time
            docs = written(docs, "decontaminated")
        docs, more = docs.mapInArrow(keep, docs.schema), True
    return docs


def op6(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))
