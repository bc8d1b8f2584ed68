"""Documents whose sets of word shingles have a Jaccard similarity of a threshold or more: an exact join by partitions of the universe.

Two sets of together S shingles reach ``percent`` if and only if they differ in at most H = S (100 - percent) / (100 + percent) shingles. Sets are dealt into
bands by size; a set is at home in one and visits the next if a set there may reach it. A band cuts the universe of shingle hashes into segments, so few
that ``H`` differences can't touch them all:

- with H + 1 + t segments at least t + 1 are equal, and every set may leave out its t most frequent ones: of the equal
  segments of a pair, the rarest is then left out by neither, as t others are more frequent in both;
- with (H + 1) / 2 segments one at least is equal or differs in a single shingle, and is found by its one-deletion neighbourhood.

Each band takes the cheaper of these by keys a set and chance meetings among all sets (``allocation``). What is left out is decided by counts over
all keys. Sets that share a key are compared by 1024 parities of their shingles, which never overstate the difference, then exactly.

Only distinct sets are compared, and no pairs of sets that are linked already: first every key's members with one in their middle, and what is far
from it with others, until all have one; then, between components only, all that the parities allow. A key of many members is dealt into blocks, so no task
holds more than two of these.

Defined results: a null text is an empty one; without words the set is empty and linked with nothing. Repeated ids and rows keep a row each. A
null id is never a component's id unless no member has another. Sets are told apart by 64-bit hashes, their shingles by 64-bit hashes of hashes of words.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import connected
from .shared import sliced, written

PARITIES = 1024
MEMBERS = 4096  # of a block of a key's members, about
RATIO = 1.25  # of a band's sizes


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only; splits at \x20 and \x09-\x0D


def hashes(w: list[bytes], words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text's words; of fewer words, of all as one."""
    if not w:
        return np.zeros(0, np.uint64)
    out, n = xxhash.xxh64_intdigest, min(words, len(w))
    h = np.fromiter((out(x, 7) for x in w), np.uint64, len(w))
    some = mix(h[: len(h) - n + 1] + np.uint64(n))
    for i in range(1, n):
        some = mix(some * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i])
    return np.unique(some)


def allowed(sizes, percent: int):
    """The shingles in which two sets of so many together may differ."""
    return sizes * (100 - percent) // (100 + percent)


def allocation(least: int, most: int, percent: int, sets: int, bits_per_shingle: float = 4) -> tuple[int, int, bool]:
    """(segments, how many of its own a set leaves out, whether neighbourhoods are indexed) of the band of sizes ``least`` to ``most``.

    The cost is the keys of a set and the sets that it meets by chance. Segments of g shingles are taken to be
    equal by chance with a probability of 2^(-``bits_per_shingle`` g), and each is empty in both sets with e^(-2g). No choice affects the result.
    """
    errors = allowed(2 * most, percent)

    def equal(t: int) -> tuple[float, tuple[int, int, bool]]:
        m = errors + 1 + t
        g = least / m
        q = min(1.0, 2 ** (-bits_per_shingle * g) + math.exp(-2 * g))
        return m + sets * min(1.0, math.comb(m, t + 1) * q ** (t + 1)), (m, t, False)

    m = (errors + 2) // 2
    g = least / m
    q = (1 + 2 * g) * min(1.0, 2 ** (-bits_per_shingle * max(0, g - 1)) + math.exp(-2 * g))
    return min([equal(t) for t in range(4)] + [(most + m + sets * min(1.0, m * q), (m, 0, True))])[1]


@lru_cache(maxsize=4)
def _bands(percent: int, sets: int, bits_per_shingle: float) -> list[tuple]:
    return []


def band(number: int, percent: int, sets: int, bits_per_shingle: float) -> tuple[int, int, tuple[int, int, bool] | None]:
    """(least size, greatest size, allocation) of a band; no allocation where only equal sets can be linked."""
    known = _bands(percent, sets, bits_per_shingle)
    while len(known) <= number:
        least = known[-1][1] + 1 if known else 1
        most = max(100 * least // percent, int(least * RATIO))
        known.append((least, most, allocation(least, most, percent, sets, bits_per_shingle) if allowed(2 * most, percent) else None))
    return known[number]


def band_keys(h: np.ndarray, mixed: np.ndarray, number: int, segments: int, neighbourhoods: bool) -> np.ndarray:
    """The keys of a set of sorted hashes in a band."""
    of = ((h >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)).astype(np.int64)
    at = np.searchsorted(of, np.arange(segments + 1))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed)])  # modulo 2^64
    sums = sums[at[1:]] - sums[at[:-1]]
    name = mix(np.arange(segments, dtype=np.uint64) + np.uint64((number + 1) << 32))
    keys = mix(sums ^ name)
    if neighbourhoods:
        keys = np.unique(np.concatenate([keys, mix((sums[of] - mixed) ^ name[of])]))
    return keys


def parities(mixed: np.ndarray, parts: int = PARITIES) -> bytes:
    """Of the shingles in each of so many parts (a power of two) of the universe."""
    of = (mixed >> np.uint64(65 - parts.bit_length())).astype(np.int64)
    return np.packbits(np.bincount(of, minlength=parts) & 1).tobytes()


def signature(h: np.ndarray, percent: int, sets: int, bits_per_shingle: float) -> tuple:
    """(parities, keys at home, keys as a visitor, left out at home, left out as a visitor)."""
    mixed, n, k = mix(h ^ np.uint64(0x5851F42D4C957F2D)), len(h), 0
    while band(k, percent, sets, bits_per_shingle)[1] < n:
        k += 1
    out = []
    for number in (k, k + 1):
        least, _, plan = band(number, percent, sets, bits_per_shingle)
        if plan is None or number > k and 100 * n < percent * least:
            out.append((np.zeros(0, np.uint64), 0))
        else:
            out.append((band_keys(h, mixed, number, plan[0], plan[2]), plan[1]))
    (home, t), (visit, u) = out
    return parities(mixed), home, visit, t, u


def _lists(values: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(values) if values else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, values)]), pa.int32()), pa.array(flat.view(np.int64)))


def prints(docs: DataFrame, *, words: int, percent: int, sets: int, bits_per_shingle: float) -> DataFrame:
    """A row per document (doc_id, said, text): the hash of its set (node; null without words), its size n and its signature, in one pass over the texts."""

    def run(batches):
        for batch in sliced(batches):
            rows = []
            for t in batch.column("text").to_pylist():
                h = hashes(split(t), words)
                some = signature(h, percent, sets, bits_per_shingle) if len(h) else (None, h, h, 0, 0)
                rows.append((node(h), len(h), *some))
            nodes, n, bits, home, visit, t, u = zip(*rows)
            cols = [batch.column("doc_id"), batch.column("said"), pa.array(nodes, pa.int64()), pa.array(n, pa.int32()), pa.array(bits, pa.binary()), _lists(home), _lists(visit), pa.array(t, pa.int32()), pa.array(u, pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "said", "node", "n", "bits", "home", "visit", "t", "u"])

    return docs.mapInArrow(run, "doc_id long, said long, node long, n int, bits binary, home array<long>, visit array<long>, t int, u int")


def node(h: np.ndarray) -> int | None:
    """The signed 64-bit hash of a set; none of an empty one."""
    return int(np.array(xxhash.xxh3_64_intdigest(h.tobytes(), 42), np.uint64).view(np.int64)) if len(h) else None


def sets_of(docs: DataFrame, nodes: DataFrame, words: int, broadcast_keys: int = 1_000_000) -> DataFrame:
    """(node, grams) of ``nodes`` (node, said): the sets, made again from the texts that they are of, and from no others.

    Up to ``broadcast_keys`` hashes of texts are broadcast, so that no text is shuffled; beyond that the join shuffles.
    """

    def run(batches):
        for batch in sliced(batches):
            some = [hashes(split(t), words) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(map(node, some), pa.int64()), _lists(some)], ["node", "grams"])

    said = written(nodes.select("said").distinct(), "sets-said")
    said = F.broadcast(said) if said.count() <= broadcast_keys else said
    texts = docs.select("said", "text").join(said, "said", "left_semi").select("text")
    return texts.mapInArrow(run, "node long, grams array<long>").where("node IS NOT NULL").dropDuplicates(["node"])


def shared_keys(nodes: DataFrame) -> DataFrame:
    """(key, node, at_home, size): the keys that several sets share and one of them is at home in, without those that a set leaves out."""
    both = [nodes.select("node", F.lit(h).alias("at_home"), F.col(t).alias("out"), F.explode(k).alias("key")) for k, h, t in (("home", True, "t"), ("visit", False, "u"))]
    meet = Window.partitionBy("key")
    met = both[0].unionAll(both[1]).withColumns({"size": F.count(F.lit(1)).over(meet), "any": F.max("at_home").over(meet)}).where("size > 1 AND any")
    met = written(met.drop("any"), "sets-keys")
    frequent = Window.partitionBy("node", "at_home").orderBy(F.desc("size"), F.desc("key"))
    left = met.where("out > 0").withColumn("place", F.row_number().over(frequent)).where("place > out").drop("place")
    return met.where("out = 0").unionAll(left).drop("out")


class Members:
    """Some members of a key: numpy columns of the same length."""

    def __init__(self, **columns):
        self.columns = columns
        self.__dict__.update(columns)

    def take(self, at) -> Members:
        return Members(**{k: v[at] for k, v in self.columns.items()})


def near(a: Members, b: Members, percent: int) -> np.ndarray:
    """Whether each of ``a`` and each of ``b`` may be linked, by sizes and parities; not two visitors, who meet elsewhere."""
    limit = allowed(a.n[:, None] + b.n[None, :], percent)
    out = (np.abs(a.n[:, None] - b.n[None, :]) <= limit) & (a.at_home[:, None] | b.at_home[None, :])
    i, j = np.nonzero(out)
    for at in range(0, len(i), 1 << 16):
        x, y = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
        out[x, y] = np.bitwise_count(a.bits[x] ^ b.bits[y]).sum(1, dtype=np.int64) <= limit[x, y]
    return out


def blocks_of(batches, by: list[str], columns: list[str]):
    """Runs of rows of equal ``by``, sorted by it, as (by, Members); one run and a batch are held."""

    def members(some: pa.Table) -> Members:
        out = {c: some.column(c).to_numpy() for c in columns if c != "bits"}
        out["bits"] = np.frombuffer(b"".join(some.column("bits").to_pylist()), np.uint64).reshape(some.num_rows, -1)
        return Members(**out)

    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(c).to_numpy() for c in by]
        cuts = [0, *(np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:]):
            now = tuple(int(k[start]) for k in keys)
            if held and held[0] != now:
                yield held[0], members(pa.Table.from_batches(held[1]))
                held = []
            held = held or [now, []]
            held[1].append(batch.slice(start, end - start))
    if held:
        yield held[0], members(pa.Table.from_batches(held[1]))


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def middles(percent: int):
    """Rows sorted by key and block -> (a, b): members with one in their middle that they may be linked to, until all have one or are alone."""

    def run(batches):
        for _, m in blocks_of(batches, ["key", "block"], ["node", "n", "at_home", "weight", "bits"]):
            ones = np.unpackbits(m.bits.view(np.uint8), axis=1)
            most = np.packbits(2 * ones.sum(0, dtype=np.int64) > len(ones)).view(np.uint64)
            order = np.lexsort((m.node, np.bitwise_count(m.bits ^ most).sum(1, dtype=np.int64), -m.weight))
            m = m.take(order)  # the set of most documents first, then those nearest to the majority
            while len(m.node) > 1:
                hit = near(m.take(slice(0, 1)), m, percent)[0]
                hit[0] = False
                if hit.any():
                    yield _pairs(np.full(hit.sum(), m.node[0]), m.node[hit])
                hit[0] = True
                m = m.take(~hit)

    return run


def between(percent: int):
    """Rows sorted by key, i and j -> (a, b): members of other components that may be linked, within block i = j or between two blocks."""

    def run(batches):
        for (_, i, j), m in blocks_of(batches, ["key", "i", "j"], ["node", "n", "at_home", "block", "root", "bits"]):
            a, b = (m, m) if i == j else (m.take(m.block == i), m.take(m.block == j))
            for at in range(0, len(a.node), 64):
                some = a.take(slice(at, at + 64))
                x, y = np.nonzero(near(some, b, percent) & (some.root[:, None] != b.root[None, :]))
                if i == j:
                    x, y = x[y > x + at], y[y > x + at]
                if len(x):
                    yield _pairs(some.node[x], b.node[y])

    return run


def verified(pairs: DataFrame, sets: DataFrame, percent: int, similar: float | None = None) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets reach the threshold, or ``similar`` where it is no whole percentage."""
    one = pairs.join(sets.select(F.col("node").alias("a"), F.col("grams").alias("x")), "a")
    two = one.join(sets.select(F.col("node").alias("b"), F.col("grams").alias("y")), "b")
    both = F.size(F.array_intersect("x", "y"))
    any_ = F.size("x") + F.size("y") - both
    return two.where(100 * both >= percent * any_ if similar is None else both >= similar * any_ - 1e-9).select("a", "b")


def _parts(rows: DataFrame) -> int:
    """A number of partitions that is kept, as few bytes can be much to compare."""
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def in_blocks(members: DataFrame) -> DataFrame:
    """``members`` of keys (key, node, size and others) with the block of each and how many their key has."""
    parts = F.ceil(F.col("size") / MEMBERS).cast("int")
    return members.withColumns({"blocks": parts, "block": F.pmod(F.xxhash64("node"), parts).cast("int")})


def pairs_with_middles(members: DataFrame, percent: int) -> DataFrame:
    """(a, b) of members in blocks: each with one in the middle of its block, and all of a key's blocks with one of its most frequent sets."""
    row = ["key", "block", "node", "n", "at_home", "weight", "bits"]
    large = members.where("blocks > 1")
    first = large.groupBy("key").agg(F.max(F.struct("weight", "node")).alias("first")).select("key", F.col("first.node").alias("node"))
    first = large.join(first, ["key", "node"]).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("other != block")
    rows = members.select(*row).unionAll(first.withColumn("block", F.col("other")).select(*row))
    rows = rows.repartition(_parts(rows), "key", "block").sortWithinPartitions("key", "block")
    return rows.mapInArrow(middles(percent), "a long, b long").distinct()


def pairs_between(members: DataFrame, percent: int) -> DataFrame:
    """(a, b) of members in blocks that have a root: all that may be linked and aren't of one root, block by block."""
    several = members.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("key")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = members.join(several, "key", "left_semi").withColumn("other", other).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    rows = rows.select("key", "i", "j", "block", "node", "n", "at_home", "root", "bits").repartition(_parts(rows), "key", "i", "j").sortWithinPartitions("key", "i", "j")
    return rows.mapInArrow(between(percent), "a long, b long").distinct()


def roots_of(docs: DataFrame, nodes: DataFrame, *, words: int, percent: int) -> DataFrame:
    """(node, root) of the linked ones of ``nodes``, the distinct sets of ``docs``."""
    members = shared_keys(nodes).join(nodes.select("node", "said", "n", "weight", "bits"), "node")
    members = written(in_blocks(members), "sets-members")
    sets = written(sets_of(docs, members, words), "sets-grams")
    tried = written(pairs_with_middles(members, percent), "sets-pairs")
    links = written(verified(tried, sets, percent), "sets-links")
    rooted = members.join(connected(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = written(rooted.drop("weight", "said"), "sets-rooted")
    left = pairs_between(rooted, percent).join(tried, ["a", "b"], "left_anti")
    more = written(verified(written(left, "sets-pairs"), sets, percent), "sets-links")
    return connected(links.unionAll(more))


def similar_sets(docs: DataFrame, *, words: int = 5, percent: int = 80, bits_per_shingle: float = 4, expected: int | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id: the smallest doc_id reachable over links of at least ``percent`` hundredths.

    Keys are allocated for ``expected`` sets, or else as many as there are documents; any number gives the same result.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(value).alias("said"), value.alias("text"))
    rows = written(prints(docs, words=words, percent=percent, sets=expected or docs.count(), bits_per_shingle=bits_per_shingle), "sets-prints")
    firsts = [F.first(c).alias(c) for c in ("n", "bits", "home", "visit", "t", "u")]  # the same in all rows of a node
    nodes = rows.where("node IS NOT NULL").groupBy("node").agg(F.min("said").alias("said"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("weight"), *firsts)
    nodes = written(nodes, "sets-nodes")
    roots = roots_of(docs, nodes, words=words, percent=percent)
    rooted = nodes.select("node", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(ids, "root").select("node", "component_id")
    out = rows.where("node IS NOT NULL").select("doc_id", "n", "node").join(named, "node").select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")
    return out.unionAll(rows.where("node IS NULL").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def op13(spark, sf_dir: str) -> DataFrame:
    return similar_sets(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), words=3, percent=90)


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) END AS g FROM w),
c AS (SELECT g, min(doc_id) AS node, len(g) AS n FROM s WHERE len(g) > 0 GROUP BY g),
i AS (SELECT node, n, unnest(g) AS x FROM c),
e AS (
  SELECT a.node AS a, b.node AS b FROM i a JOIN i b ON a.x = b.x AND a.node < b.node AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (
  SELECT node, node AS root FROM c
  UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.root),
k AS (SELECT node, min(root) AS component_id FROM r GROUP BY 1)
SELECT s.doc_id, len(s.g)::BIGINT AS n_shingles, coalesce(k.component_id, s.doc_id) AS component_id
FROM s LEFT JOIN c ON c.g = s.g AND len(s.g) > 0 LEFT JOIN k ON k.node = c.node
"""
