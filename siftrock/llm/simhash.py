"""SimHash near-duplicates with pigeonring filtering.

A 64-bit fingerprint is a ring of eight segments. If two fingerprints differ in at most four bits, at least four segments are
equal, and from some segment on the differences of every chain of consecutive segments stay within the chain's share of
the budget: 0, 1, 1, 2, 2, 3, 3, 4 bits for chains of 1 to 8 segments. The keys are the 70 choices of four segments (32 bits), whatever the
number of fingerprints, so unlike ones hardly ever meet. Two that meet must pass the chains; only then all bits are counted.

Only distinct fingerprints are compared, and no pairs are made within a group. A key that two of them share
gives its pair from an aggregate (least, greatest, count). Fingerprints under any fuller key are so dense that they are linked exactly by
neighbours: two of them lie within four bits if and only if some value lies within two bits of
both, so all that share one of their 2,081 neighbouring values are linked to the smallest of these. Work and
rows grow with the number of fingerprints, not with the square of a group.

Word shingles ask for more: at a Jaccard similarity of 0.8 two SimHashes differ in 0.15 of their bits, far beyond what
keys of whole segments can promise. ``similar_classes`` takes a ring of 256 bits from distinct shingles and looks up
arcs of it, in several orders of the bits, so many that a pair just at the threshold shares an arc with a probability
of 0.99; what meets within the ring's budget of bits is checked by the 64-bit hashes of its shingles. Recall is that of the arcs and the
budget. Nodes under one arc are compared where they are, without a row for each pair (see ``set_join``).

Defined results: a null text is an empty one; without words the fingerprint is zero and is linked like any
other. Repeated ids and rows keep a row each. A null id is never a component's id unless no member has another.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import set_join
from .components import connected
from .shared import free_name, sliced, written

BITS, DIFFER, SEGMENTS = 64, 4, 8
RING, MISSED, FEW, FIRST, PARITIES, WIDTH = 256, 0.01, 64, 4, 512, 20
RING_SEEDS = (0x2545F4914F6CDD1D, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def fingerprint(text: str | None, words: int, seed: int = 42) -> int:
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only; splits at \x20 and \x09-\x0D
    if not w:
        return 0
    shingles = [b" ".join(w)] if len(w) < words else list(map(b" ".join, zip(*(w[i:] for i in range(words)))))
    h, n = xxhash.xxh64_intdigest, len(shingles)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):  # a bounded bit matrix, however long the text is
        some = shingles[at : at + (1 << 16)]
        values = np.fromiter((h(s, seed) for s in some), "<u8", len(some))
        counts += np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, words: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's bits as a signed long."""

    def run(batches):
        for batch in sliced(batches):
            values = np.array([fingerprint(t, words) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def segments(bits: list[int]) -> list[int]:
    """Masks of ``SEGMENTS`` runs of these bits, as even as can be."""
    cuts = [len(bits) * i // SEGMENTS for i in range(SEGMENTS + 1)]
    return [sum(1 << b for b in bits[low:high]) for low, high in zip(cuts, cuts[1:])]


def key_masks(bits: list[int]) -> list[int]:
    """Masks of every choice of ``SEGMENTS - DIFFER`` segments: whatever four bits differ, one of these has none of them."""
    return [sum(some) for some in combinations(segments(bits), SEGMENTS - DIFFER)]


def ring_test(a: str = "a", b: str = "b") -> str:
    """SQL: from some segment on all chains are within their shares of the budget, and then all bits are."""
    ring = segments(list(range(BITS)))
    chain = lambda i, n: sum(ring[(i + j) % SEGMENTS] for j in range(n))
    starts = [" AND ".join(f"bit_count(({a} ^ {b}) & {_long(chain(i, n))}) <= {n * DIFFER // SEGMENTS}" for n in range(1, SEGMENTS)) for i in range(SEGMENTS)]
    return f"({' OR '.join(f'({s})' for s in starts)}) AND bit_count({a} ^ {b}) <= {DIFFER}"


def _long(value: int) -> str:
    v = _signed(value)
    return "(-9223372036854775807L - 1L)" if v == -(1 << 63) else f"{v}L"


def _longs(values: list[int]) -> str:
    return f"array({', '.join(map(_long, values))})"


def links(nodes: DataFrame, *, broadcast_keys: int = 1_000_000) -> DataFrame:
    """(a, b): pairs of the distinct values ``fp`` of ``nodes``, a written table, at most four bits apart, that connect all such pairs.

    The fuller keys, counted first, are broadcast if at most ``broadcast_keys`` of them (some 12 bytes each); beyond
    that the join shuffles.
    """
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    nodes = nodes.select("fp").repartition(parts)  # a few bytes a row here, dozens of keys a row below
    keys = nodes.select("fp", F.expr(f"posexplode(transform({_longs(key_masks(list(range(BITS))))}, m -> fp & m)) AS (k, v)"))
    met = keys.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1")
    met = written(met, "simhash-keys")
    pairs = met.where(f"n = 2 AND {ring_test()}").select("a", "b")

    near = [0, *(1 << i for i in range(BITS)), *((1 << i) | (1 << j) for i in range(BITS) for j in range(i))]
    fuller = met.where("n > 2").select("k", "v")
    fuller = F.broadcast(fuller) if fuller.count() <= broadcast_keys else fuller
    dense = written(keys.join(fuller, ["k", "v"], "left_semi").select("fp").distinct(), "simhash-dense")
    around = dense.repartition(parts).select("fp", F.explode(F.expr(f"transform({_longs(near)}, m -> fp ^ m)")).alias("v"))
    low = F.min("fp").over(Window.partitionBy("v"))  # a value has 2,081 neighbours at most
    stars = around.select(low.alias("a"), F.col("fp").alias("b")).where("a < b")
    return pairs.unionAll(stars).distinct()


def classes(prints: DataFrame, **options) -> DataFrame:
    """(fp, root, component_id) for every distinct fp of ``prints`` (doc_id, fp), a table that is read more than once."""
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    roots = connected(links(nodes, **options))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(ids, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, *, words: int = 4, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id: the smallest doc_id reachable by links."""
    prints = written(fingerprints(docs, words=words, doc_id=doc_id, text=text), "fingerprints")
    out = prints.join(classes(prints, **options), "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def node(w: list[bytes]) -> int:
    """What texts of the same words share: a signed 64-bit hash."""
    return _signed(xxhash.xxh3_64_intdigest(b" ".join(w), 42))


def ring(h: np.ndarray) -> np.ndarray:
    """The SimHash in 256 bits of a set, given by the hashes of its members, as four words."""
    counts = np.zeros(RING, np.int64)
    for at in range(0, len(h), 1 << 14):  # a bounded bit matrix
        some = np.stack([set_join.mix(h[at : at + (1 << 14)] ^ np.uint64(seed)) for seed in RING_SEEDS], 1).astype("<u8")
        counts += np.unpackbits(some.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(counts * 2 > len(h), bitorder="little").view("<u8")


def rings(docs: DataFrame, *, words: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, node, n, bits, f0, f1, f2, f3): a text's node, the size of its set of shingles, the set's parities and ring."""

    def run(batches):
        for batch in sliced(batches):
            f, nodes, n, bits = np.zeros((batch.num_rows, 4), np.uint64), [], [], []
            for i, t in enumerate(batch.column("text").to_pylist()):  # a text's words at a time
                w = _words(t)
                h = set_join.hashes(w, words)
                f[i] = ring(h)
                nodes.append(node(w))
                n.append(len(h))
                bits.append(set_join.parities(set_join.mix(h), PARITIES))
            f = f.view(np.int64)
            cols = [batch.column("doc_id"), pa.array(nodes, pa.int64()), pa.array(n, pa.int32()), pa.array(bits, pa.binary()), *(pa.array(f[:, i].copy()) for i in range(4))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "node", "n", "bits", "f0", "f1", "f2", "f3"])

    some = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return some.mapInArrow(run, "doc_id long, node long, n int, bits binary, f0 long, f1 long, f2 long, f3 long")


def bit_budget(similar: float, bits: int, spread: float) -> int:
    """Bits of ``bits`` in which sets of that Jaccard similarity differ: at most the angle's share, and ``spread`` deviations."""
    p = math.acos(2 * similar / (1 + similar)) / math.pi
    return math.ceil(bits * p + spread * math.sqrt(bits * p * (1 - p)))


def arcs(n: int, similar: float, seed: int = 7) -> np.ndarray:
    """Masks (rows of four words) of the arcs that ``n`` rings are looked up by: log2(n) bits each and ``WIDTH`` at least, so that few unlike rings
    meet, and as many as hold the share missed at the threshold to ``MISSED``."""
    width = max(WIDTH, math.ceil(math.log2(max(n, 2))))
    p = 1 - math.acos(2 * similar / (1 + similar)) / math.pi
    many, rng, out = math.ceil(math.log(MISSED) / math.log(1 - p**width)), np.random.default_rng(seed), []
    while len(out) < many:
        order = rng.permutation(RING)
        for at in range(0, RING - width + 1, width):
            bits = np.zeros(RING, np.uint8)
            bits[order[at : at + width]] = 1
            out.append(np.packbits(bits, bitorder="little").view("<u8"))
    return np.array(out[:many])


FOLDED = ["key", "node", "f0", "root", "n", "g0", "g1"]


def folded(bits: np.ndarray) -> np.ndarray:
    """Parities (rows of words) of parts of the universe so coarse that they fit two words; they don't overstate how sets differ, either."""
    half = bits.shape[1] // 2
    return np.stack([np.bitwise_xor.reduce(bits[:, :half], 1), np.bitwise_xor.reduce(bits[:, half:], 1)], 1)


def _partners(limit: int, few: int, percent: int):
    """Rows (``FOLDED``) sorted by key -> (key, node): those that have another of their key with another root, first words at most
    ``limit`` bits apart, that sizes and folded parities (g0, g1) allow to reach ``percent``. Under a key of more than ``few`` nodes all stay. Holds
    ``few`` rows beside a batch, however many a key has."""

    def rows(key, node):
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(node)], ["key", "node"])

    def within(key, node, f0, root, n, g0, g1):
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        size = np.repeat(sizes, sizes)
        left, keep = np.repeat(starts + sizes, sizes) - np.arange(len(key)), size > few  # rows from here to the key's end
        for d in range(1, few):
            i = np.flatnonzero((left > d) & (size <= few))
            if not len(i):
                break
            i = i[(root[i] != root[i + d]) & (np.bitwise_count((f0[i] ^ f0[i + d]).view(np.uint64)) <= limit)]
            j, most = i + d, set_join.allowed(n[i].astype(np.int64) + n[i + d], percent)
            apart = sum(np.bitwise_count((g[i] ^ g[j]).view(np.uint64)).astype(np.int64) for g in (g0, g1))
            i = i[np.maximum(apart, np.abs(n[i] - n[j])) <= most]
            keep[i] = keep[i + d] = True
        return rows(key[keep], node[keep])

    def run(batches):
        held, full = [np.zeros(0, np.int64)] * len(FOLDED), None  # the last key's rows so far; of a key of more than a few none
        for batch in batches:
            now = [np.concatenate(x) for x in zip(held, (batch.column(c).to_numpy() for c in FOLDED), strict=True)]
            held = [x[:0] for x in now]
            if full is not None:
                n = int(np.searchsorted(now[0], full, side="right"))
                yield rows(now[0][:n], now[1][:n])
                now = [x[n:] for x in now]
            if len(now[0]):
                cut, full = int(np.searchsorted(now[0], now[0][-1])), None
                yield within(*(x[:cut] for x in now))
                held = [x[cut:] for x in now]
                if len(held[0]) > few:
                    yield rows(held[0], held[1])
                    full, held = held[0][0], [x[:0] for x in held]
        yield within(*held)

    return run


def similar_classes(docs: DataFrame, prints: DataFrame, *, words: int, similar: float, doc_id: str = "doc_id", text: str = "text", broadcast_keys: int = 1_000_000) -> DataFrame:
    """(node, root, component_id) for every distinct node of ``prints``, the written ``rings`` of ``docs``.

    Links are the pairs that share an arc, lie within the bit budget and have that Jaccard similarity of distinct
    shingles. What ``FIRST`` arcs link with one in the middle of its key are groups of copies; under all arcs only nodes that this left apart meet. They are
    compared in the task that holds a block of their key's members, by parities that never overstate how sets differ, so
    that pairs become rows only if they are likely links; this finds the same components as all pairs.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole, percent = bit_budget(similar, RING, 3), math.floor(100 * similar + 1e-9)
    same = [F.min(c).alias(c) for c in ("n", "bits", *(f"f{i}" for i in range(4)))]  # in all rows of a node
    nodes = written(prints.groupBy("node").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("weight"), *same), "ring-nodes")
    masks, quarter = arcs(nodes.count(), similar), bit_budget(similar, 64, 4.5)
    odd = np.random.default_rng(3).integers(1 << 62, size=(len(masks), 5), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def keys(roots: DataFrame | None, many: int) -> DataFrame:
        """(``FOLDED``) of the first ``many`` arcs; without ``roots`` every node is its own."""

        def run(batches):
            for batch in batches:
                f = np.stack([batch.column(f"f{i}").to_numpy() for i in range(4)], 1).view(np.uint64)
                g = folded(np.frombuffer(b"".join(batch.column("bits").to_pylist()), np.uint64).reshape(batch.num_rows, -1)).view(np.int64)
                rest = [*(batch.column(c) for c in ("node", "f0", "root", "n")), *(pa.array(g[:, k].copy()) for k in range(2))]
                for m, o in zip(masks[:many], odd[:many], strict=True):
                    key = ((f & m) * o[:4]).sum(1, dtype=np.uint64) + o[4]
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *rest], FOLDED)

        some = rooted(nodes, roots).select("node", "n", "bits", "f0", "f1", "f2", "f3", "root").repartition(parts)
        return some.mapInArrow(run, "key long, node long, f0 long, root long, n int, g0 long, g1 long")

    def rooted(some: DataFrame, roots: DataFrame | None) -> DataFrame:
        if roots is None:
            return some.withColumn("root", F.col("node"))
        return some.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))

    def members(roots: DataFrame | None, many: int) -> DataFrame:
        """The nodes that have a partner of another root under one of the first ``many`` arcs, in blocks of their keys."""
        met = keys(roots, many).repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_partners(quarter, FEW, percent), "key long, node long")
        met = written(met, "ring-met").withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("key")))
        some = rooted(nodes.select("node", "n", "weight", "bits"), roots)
        return written(set_join.in_blocks(met.join(some, "node")).withColumn("at_home", F.lit(True)), "ring-members")

    def hashed(batches):
        for batch in sliced(batches):
            found = [_words(t) for t in batch.column("text").to_pylist()]
            sets = [set_join.hashes(w, words).view(np.int64) for w in found]
            yield pa.RecordBatch.from_arrays([pa.array(map(node, found), pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["node", "grams"])

    def checked(pairs: DataFrame) -> DataFrame:
        side = lambda c: nodes.select(F.col("node").alias(c), *[F.col(f"f{i}").alias(f"{c}{i}") for i in range(4)])
        apart = " + ".join(f"bit_count(a{i} ^ b{i})" for i in range(4))
        near = written(pairs.join(side("a"), "a").join(side("b"), "b").where(f"{apart} <= {whole}").select("a", "b"), "ring-near")
        needed = near.select("a").unionAll(near.select("b")).distinct().toDF("node").join(nodes.select("node", "least"), "node")
        needed = written(needed, "ring-needed")
        needed = F.broadcast(needed) if needed.count() <= broadcast_keys else needed
        some = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
        some = some.join(needed, F.col("doc_id").eqNullSafe(F.col("least")), "left_semi")  # so that only these texts are hashed again
        known = some.select("text").mapInArrow(hashed, "node long, grams array<long>").join(needed.select("node"), "node", "left_semi")
        known = written(known.dropDuplicates(["node"]), "ring-shingles")
        return written(set_join.verified(near, known, percent, similar), "ring-links")

    linked = checked(set_join.pairs_with_middles(members(None, FIRST), percent))
    apart = members(written(connected(linked), "ring-roots"), len(masks))
    roots = connected(linked.unionAll(checked(set_join.pairs_between(apart, percent))))
    out = rooted(nodes, roots)
    ids = out.groupBy("root").agg(F.min("least").alias("component_id"))
    return out.join(ids, "root").select("node", "root", "component_id")


def keep_one(docs: DataFrame, *, words: int = 5, similar: float | None = None, doc_id: str = "doc_id", text: str = "text", broadcast_keys: int = 1_000_000, **options) -> DataFrame:
    """``docs`` without all but one row of each component: that of the smallest id, and of those that repeat this id with other texts
    that of the smallest fingerprint (or node). Links are those of ``similar_classes`` where ``similar`` is given, else
    fingerprints at most four bits apart.

    Rows without an id stay: no member of a group can be told from them. Up to ``broadcast_keys`` ids of rows that go are broadcast; beyond
    that the join shuffles.
    """
    if similar is None:
        prints = written(fingerprints(docs, words=words, doc_id=doc_id, text=text), "fingerprints")
        found = prints.join(classes(prints, broadcast_keys=broadcast_keys, **options), "fp").select("doc_id", F.col("fp").alias("_key"), "root")
        key_of = lambda t: _signed(fingerprint(t, words))
    else:
        prints = written(rings(docs, words=words, doc_id=doc_id, text=text), "rings")
        found = prints.join(similar_classes(docs, prints, words=words, similar=similar, doc_id=doc_id, text=text, broadcast_keys=broadcast_keys, **options), "node").select("doc_id", F.col("node").alias("_key"), "root")
        key_of = lambda t: node(_words(t))
    found = written(found.where("doc_id IS NOT NULL").groupBy("root", "doc_id", "_key").agg(F.count(F.lit(1)).alias("_n")), "members")
    stay = found.groupBy("root").agg(F.min(F.struct("doc_id", "_key", "_n")).alias("s"))
    stay = written(stay.select(F.col("s.doc_id").alias(doc_id), "s._key", "s._n"), "kept")
    more = written(stay.where("_n > 1"), "repeated")
    more = F.broadcast(more) if more.count() <= broadcast_keys else more
    gone = found.select(F.col("doc_id").alias(doc_id), "_key").join(stay.where("_n = 1"), [doc_id, "_key"], "left_anti")  # these, too, of which rows repeat
    gone = written(gone, "gone")

    def run(batches):
        for batch in sliced(batches):
            values = pa.array([key_of(t) for t in batch.column(text).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, values], [*batch.schema.names, "_key"])

    def keyed(some: DataFrame) -> DataFrame:
        return some.mapInArrow(run, StructType([*docs.schema.fields, StructField("_key", LongType())]))

    if gone.count() <= broadcast_keys:  # no text is shuffled, and only those of ids that go are hashed again
        gone, known = F.broadcast(gone), docs.where(F.col(doc_id).isNotNull())
        ids = F.broadcast(gone.select(doc_id).distinct())
        unsure = keyed(known.join(ids, doc_id, "left_semi")).join(gone, [doc_id, "_key"], "left_anti")
        once = known.join(ids, doc_id, "left_anti").unionByName(unsure.select(*docs.columns))
    else:
        once = keyed(docs).join(stay.where("_n = 1"), [doc_id, "_key"], "left_semi").select(*docs.columns)
    repeated = keyed(docs.join(more, doc_id, "left_semi")).join(more, [doc_id, "_key"], "left_semi").dropDuplicates([doc_id, "_key"])
    return once.unionByName(repeated.select(*docs.columns)).unionByName(docs.where(F.col(doc_id).isNull()))


def op2(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), words=4)
