"""Packing into fixed-length sequences as a cutting-stock problem, solved by column generation.

A document's ids are cut at every multiple of the sequence length and nowhere else; the full pieces are sequences of their
own. What is left of each document, one piece of 1 to ``size - 1`` ids, stays whole. A linear program over patterns
(multisets of lengths that fit a sequence) minimises sequences; columns are priced by an unbounded-knapsack
dynamic program on the duals. Its solution is rounded down, the few pieces left over are packed best-fit, and the
patterns' slots go to the documents of each length by rank. Ranks come from counts by (writing task, length) and their prefix
sums, so a hot length is never gathered or sorted in one place. The program has at most ``size - 1`` lengths, whatever the
number of documents.

Defined results: a null text is an empty one, so that its document is the end id alone. Repeated rows
and null ids are packed as documents of their own. An empty table gives no rows. ``place`` keeps the columns of its pieces but
replaces ``sequence_id`` and ``offset``, which it makes.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .shared import free_name, sliced, written
from .tokens import encoder

SIZE = 1024


# ---- the plan: from a histogram of piece lengths, at most size - 1 of them, on the driver


def _knapsack(value: np.ndarray, lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Best value of each capacity and the length taken last (0: leave one unit free); value by length, lengths ascending."""
    best, took = np.zeros(size + 1), np.zeros(size + 1, np.int64)
    for room in range(1, size + 1):
        n = np.searchsorted(lengths, room, side="right")
        best[room], took[room] = best[room - 1], 0
        if n:
            total = value[:n] + best[room - lengths[:n]]
            i = int(np.argmax(total))
            if total[i] > best[room] + 1e-12:
                best[room], took[room] = total[i], lengths[i]
    return best, took


def _pattern(took: np.ndarray, room: int) -> Counter:
    out: Counter = Counter()
    while room > 0:
        if took[room]:
            out[int(took[room])] += 1
            room -= int(took[room])
        else:
            room -= 1
    return out


def _start(demand: dict[int, int], size: int) -> tuple[list[Counter], np.ndarray, np.ndarray]:
    """A pattern per length and its uses, covering ``demand`` exactly: the longest length left is filled up with the best sum of others
    left, and that is repeated until a length runs out, whose pattern it then is. In the order in which lengths run out the patterns are
    triangular, so they are a basis of the program; its inverse is the third result (patterns by lengths)."""
    left = {n: float(v) for n, v in demand.items()}
    basis: dict[int, Counter] = {}
    uses: dict[int, float] = {}
    while left:
        lengths = np.array(sorted(left), np.int64)
        longest = int(lengths[-1])
        room = size - longest
        few = lengths[lengths <= room]
        p = Counter({longest: 1})
        if len(few):
            # subset sum within what is left of each length: reachable sums, each with the length that reached it first
            reached, by = np.zeros(room + 1, bool), np.zeros(room + 1, np.int64)
            reached[0] = True
            for n in few[::-1].tolist():
                most = min(room // n, int(left[n]) - (n == longest))
                for _ in range(max(0, most)):
                    new = np.flatnonzero(reached[: room + 1 - n] & ~reached[n:]) + n
                    if not len(new):
                        break
                    reached[new], by[new] = True, n
                if reached[room]:
                    break
            at = int(np.flatnonzero(reached)[-1])
            while at:
                p[int(by[at])] += 1
                at -= int(by[at])
        times = {n: left[n] / k for n, k in p.items()}
        gone = min(times, key=lambda n: (times[n], n))
        basis[gone], uses[gone] = p, times[gone]
        for n, k in p.items():
            left[n] = max(0.0, left[n] - k * times[gone])
        del left[gone]
    order, lengths = list(basis), sorted(demand)
    at = {n: i for i, n in enumerate(lengths)}
    holders: dict[int, list[int]] = {n: [] for n in order}
    inverse = np.zeros((len(order), len(order)))
    for j, n in enumerate(order):  # forward substitution over the few patterns that hold each length
        row = inverse[at[n]]
        row[at[n]] = 1.0
        for i in holders[n]:
            row -= basis[order[i]][n] * inverse[at[order[i]]]
        row /= basis[n][n]
        for other in basis[n]:
            if other != n:
                holders[other].append(j)
    return [basis[n] for n in lengths], np.array([uses[n] for n in lengths]), inverse


def column_generation(demand: dict[int, int], size: int = SIZE, *, gap: float = 5e-4, work: float = 5e8) -> tuple[list[tuple[Counter, float]], float]:
    """Patterns with their (fractional) uses covering ``demand`` exactly, and a lower bound on the uses of any cover.

    Revised simplex with an explicit inverse. Columns are priced by a knapsack over the duals, smoothed towards the best duals so far
    (those of the highest bound, at first each length's share of a sequence); each pricing gives the best pattern holding
    each length, and pivots go on among those before the next. Ends within ``gap`` of the bound or one sequence of it, or after
    ``work`` changed numbers of the inverse (some seconds), when the bound returned tells how far it is.
    """
    lengths = np.array(sorted(demand), np.int64)
    d = np.array([demand[int(n)] for n in lengths], float)
    at = {int(n): i for i, n in enumerate(lengths)}
    m = len(lengths)
    basis, x, inverse = _start(demand, size)
    times = lambda matrix, v: np.einsum("ij,j->i", matrix, v)  # noqa: E731 (one thread: a driver has others for its cores)
    stable, bound, pivots, smooth = lengths / size, float(lengths @ d) / size, 0, 0.7
    max_pivots = int(work / m**2) + 1
    while pivots < max_pivots and x.sum() - bound > max(1.0, gap * x.sum()):
        y = inverse.sum(0)
        value = np.maximum(smooth * stable + (1 - smooth) * y, 0)
        best, took = _knapsack(value, lengths, size)
        if value @ d / best[size] > bound:
            bound, stable = value @ d / best[size], value / best[size]
        pool = {}
        for n in lengths.tolist():
            p = _pattern(took, size - n)
            p[n] += 1
            pool[frozenset(p.items())] = p
        pool = list(pool.values())
        columns = np.zeros((len(pool), m))
        for row, p in enumerate(pool):
            for n, k in p.items():
                columns[row, at[n]] = k
        before = pivots
        for _ in range(m):
            gain = times(columns, y) - 1
            j = int(np.argmax(gain))
            if gain[j] <= 1e-7 or pivots >= max_pivots:
                break
            w = times(inverse, columns[j])
            ratio = np.where(w > 1e-9, x / np.where(w > 1e-9, w, 1), np.inf)
            out = int(np.argmin(ratio))
            step = ratio[out]
            x = np.maximum(x - step * w, 0)
            x[out] = step
            row = inverse[out] / w[out]
            y = y - gain[j] * row
            w[out] = 0
            hit = np.flatnonzero(np.abs(w) > 1e-12)
            inverse[hit] -= w[hit, None] * row
            inverse[out] = row
            basis[out] = pool[j]
            pivots += 1
        if pivots == before:  # no column of these prices helps: the duals themselves price next, or all is done
            if smooth == 0:
                break
            smooth = smooth / 2 if smooth > 0.1 else 0
        else:
            smooth = 0.7
    return list(zip(basis, x.tolist(), strict=True)), bound


def plan(demand: dict[int, int], size: int = SIZE, **limits) -> list[tuple[Counter, int]]:
    """Whole uses of patterns that hold every remainder exactly once: the rounded program, then best-fit for the rest."""
    if not demand:
        return []
    left, out = Counter(demand), []
    for p, uses in column_generation(demand, size, **limits)[0]:
        n = int(uses + 1e-9)
        n = min([n, *(left[length] // k for length, k in p.items())])
        if n > 0:
            out.append((p, n))
            for length, k in p.items():
                left[length] -= k * n
    rooms: dict[int, list[Counter]] = {}
    for length in sorted(left, reverse=True):
        for _ in range(left[length]):
            room = next((r for r in range(length, size) if rooms.get(r)), None)
            p = rooms[room].pop() if room is not None else Counter()
            p[length] += 1
            rooms.setdefault((size if room is None else room) - length, []).append(p)
    merged = Counter(frozenset(p.items()) for some in rooms.values() for p in some)
    return out + [(Counter(dict(p)), n) for p, n in sorted(merged.items(), key=lambda x: sorted(x[0]))]


def slots(patterns: list[tuple[Counter, int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """Per length: first rank, first sequence, slots a sequence and first offset of each run of slots."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    upto: Counter = Counter()
    sequence = 0
    for p, n in patterns:
        offset = 0
        for length in sorted(p, reverse=True):
            runs.setdefault(length, []).append((upto[length], sequence, p[length], offset))
            upto[length] += p[length] * n
            offset += p[length] * length
        sequence += n
    return {k: tuple(np.array(c, np.int64) for c in zip(*v, strict=True)) for k, v in runs.items()}


# ---- the job

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, task int, nth long"


def cut_pieces(docs: DataFrame, tokenizer: str, *, spaces: str = "whole", end_id: int, size: int = SIZE, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """The pieces of every document, with the task that cut them and their number there among pieces of their length."""
    schema = PIECES + (", ids binary" if with_ids else "")

    def cut(batches):
        from pyspark import TaskContext

        enc = encoder(tokenizer, spaces)
        task, met = TaskContext.get().partitionId(), Counter()
        end = np.array([end_id], "<u4")
        for some in sliced(batches):
            rows: list[list] = [[] for _ in range(8)]
            for key, data in zip(some.column("doc_id").to_pylist(), enc.encode(some.column("text").to_pylist()), strict=True):
                ids = np.concatenate([np.frombuffer(data, enc.dtype).astype("<u4"), end])
                for start in range(0, len(ids), size):
                    piece = ids[start : start + size]
                    n = len(piece)
                    for col, v in zip(rows, (key, start, n, zlib.crc32(piece), len(ids), task, met[n], piece.tobytes() if with_ids else None), strict=True):
                        col.append(v)
                    met[n] += 1
            kinds = [pa.int64()] * 5 + [pa.int32(), pa.int64()] + [pa.binary()] * with_ids
            names = [c.split()[0] for c in schema.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=False)], names)

    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return texts.mapInArrow(cut, schema)


def place(pieces: DataFrame, *, size: int = SIZE, **limits) -> DataFrame:
    """``pieces`` (length, task, nth and any others; read more than once, so a written table) with sequence_id and offset."""
    pieces = pieces.drop("sequence_id", "offset")
    columns = pieces.columns
    base, rank = free_name(pieces, "base"), free_name(pieces, "rank")
    counts = pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # a row per task
    based = written(counts.withColumn(base, F.coalesce(F.sum("n").over(before), F.lit(0))), "pack-counts")
    histogram = {r.length: r.n for r in based.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``size`` rows
    full = histogram.pop(size, 0)
    runs = slots(plan(histogram, size, **limits)) | {size: tuple(np.array([v], np.int64) for v in (0, -full, 1, 0))}
    ranked = pieces.join(based.select("task", "length", base), ["task", "length"]).select(*columns, (F.col("nth") + F.col(base)).alias(rank))

    def assign(batches):
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            order = batch.column(rank).to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
            for n in np.unique(length).tolist():
                first, begin, each, start = runs[n]
                mine = np.flatnonzero(length == n)
                k = np.searchsorted(first, order[mine], side="right") - 1
                j = order[mine] - first[k]
                sequence[mine] = full + begin[k] + j // each[k]
                offset[mine] = start[k] + (j % each[k]) * n
            out = batch.drop_columns([rank])
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(sequence), pa.array(offset)], [*columns, "sequence_id", "offset"])

    kinds = StructType([*pieces.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    return ranked.mapInArrow(assign, kinds)


def pack(docs: DataFrame, tokenizer: str, *, spaces: str = "whole", end_id: int, size: int = SIZE, with_ids: bool = False, **columns) -> DataFrame:
    pieces = written(cut_pieces(docs, tokenizer, spaces=spaces, end_id=end_id, size=size, with_ids=with_ids, **columns), "pieces")
    return place(pieces, size=size).drop("task", "nth")


def pack_documents(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), spaces="leading", end_id=0)


def op7(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
