"""Approximate nearest neighbours by shifted space-filling curves.

Each curve orders all vectors along a Hilbert curve through a random low-dimensional projection whose
coordinates are mapped to ranks (by quantiles of a bounded sample) and shifted at random. A curve's keys are range-partitioned and
sorted by Spark, a copy of each vector on each curve; a query takes its place among them and is scored, in double precision on the
original vectors, against the ``window`` vectors before it and after it. The curves' results are merged and ranked again.
A task holds a few windows at a time. Windows end at a partition's borders; partitions hold 16 windows and more, and other
curves have other borders, so that costs a little recall, no rows.

The number of curves and the window are those with the fewest scored pairs whose recall on the sample, against brute force, reaches
``target``. Many curves with narrow windows find more than few with wide ones. For vectors with structure the windows are slivers; for
directionless ones they stay a share of all vectors: no ordering can help there, and the scan grows with that share.
Every row is indexed; only projections, quantiles, curves and window come from the sample (``sample_rows``).

Largest inner products are nearest neighbours after a further coordinate evens out the lengths. Equal
vectors are one entry with its ``k + 1`` smallest ids, so a hot vector fills no window, and ties go to smaller ids exactly.

Defined results: vectors that are null, zero, or hold null or non-finite numbers take no part; nor do those without id
or of another length than most. Of rows that repeat an id, the largest vector counts. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .shared import hash_cut, sliced, written

TIE_BITS = 7
#: Numbers of curves that are tried on the sample.
CURVES = (4, 8, 16, 32, 48)


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Keys along the Hilbert curve of integer points (rows), by transposed Gray-code bit planes (Skilling 2004)."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    for plane in range(bits - 1, 0, -1):
        q, low = 1 << plane, (1 << plane) - 1
        for i in range(n):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for plane in range(bits - 1, 0, -1):
        flip ^= np.where((x[n - 1] >> plane) & 1, (1 << plane) - 1, 0)
    x ^= flip
    key = np.zeros_like(x[0])
    for plane in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> plane & 1)
    return key


class Curves:
    """What orders vectors: projections, quantile knots and shifts, all from a sample and a seed."""

    def __init__(self, sample: np.ndarray, longest: float, curves: int, width: int, seed: int):
        rng = np.random.default_rng(seed)
        d = sample.shape[1] + 1
        self.longest, self.width = longest, min(width, d)
        self.bits = min(12, (62 - TIE_BITS) // self.width)
        self.projections = [np.linalg.qr(rng.normal(size=(d, self.width)))[0] for _ in range(curves)]
        self.shifts = rng.random((curves, self.width))
        grid = np.linspace(0, 1, 257)
        self.knots = [np.quantile(self.lengthened(sample) @ p, grid, axis=0) for p in self.projections]

    def keep(self, curves: int) -> None:
        """Only the first so many."""
        self.projections, self.knots, self.shifts = self.projections[:curves], self.knots[:curves], self.shifts[:curves]

    def lengthened(self, x: np.ndarray, queries: bool = False) -> np.ndarray:
        squares = (x * x).sum(1)
        if queries:
            return np.column_stack([x * (self.longest / np.sqrt(squares))[:, None], np.zeros(len(x))])
        return np.column_stack([x, np.sqrt(np.maximum(self.longest**2 - squares, 0))])

    def keys(self, x: np.ndarray, ids: np.ndarray, queries: bool = False) -> np.ndarray:
        """A key for each vector (row) and curve; the last bits, from the id, tell apart vectors of the same cell."""
        grid, long = np.linspace(0, 1, 257), self.lengthened(x, queries)
        tie = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - TIE_BITS)).astype(np.int64)
        out = np.empty((len(x), len(self.projections)), np.int64)
        for c, (p, knots, shift) in enumerate(zip(self.projections, self.knots, self.shifts, strict=True)):
            y = long @ p
            u = np.column_stack([np.interp(y[:, j], knots[:, j], grid) for j in range(self.width)])
            cells = np.minimum((u + shift) / 2 * (1 << self.bits), (1 << self.bits) - 1).astype(np.int64)
            out[:, c] = hilbert(cells, self.bits) << TIE_BITS | tie
        return out


def pick(order: Curves, sample: np.ndarray, total: int, k: int, target: float, queries: int = 256) -> tuple[int, float]:
    """(curves, window as a share of a curve) with the fewest scored pairs whose recall on the sample reaches ``target``. Of ``total``
    entries the ``k`` nearest are as near as the ``k * len(sample) / total`` nearest of the sample, so recall is that of those."""
    n = len(sample)
    ids = np.arange(n)
    some = ids[:: max(1, n // queries)]
    data, asked = order.keys(sample, ids), order.keys(sample[some], some, queries=True)
    scores = sample[some] @ sample.T
    scores[np.arange(len(some)), some] = -np.inf
    near = max(1, min(n - 1, -(-k * n // total)))
    best = np.argpartition(-scores, near - 1, axis=1)[:, :near]
    apart, tried = np.full(best.shape, np.inf), []
    for c in range(data.shape[1]):
        sorted_keys = np.sort(data[:, c])
        at, of = np.searchsorted(sorted_keys, data[:, c]) / n, np.searchsorted(sorted_keys, asked[:, c]) / n
        apart = np.minimum(apart, np.abs(at[best] - of[:, None]))
        if c + 1 in CURVES:
            window = float(np.quantile(apart, target, method="higher")) + 1 / n
            tried.append(((c + 1) * max(window, 1 / 500), c + 1, window))
    return min(tried)[1:]


def valid(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(id, v array<double>) of the vectors that take part, an id once."""
    v = F.col(embedding)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))) & F.exists(v, lambda x: x != 0)
    kind = "array<float>" if vectors.schema[embedding].dataType == ArrayType(FloatType()) else "array<double>"  # floats are shipped as they are
    rows = vectors.where(F.col(vec_id).isNotNull() & fine).select(F.col(vec_id).cast("long").alias("id"), v.cast(kind).alias("v"))
    return rows.groupBy("id").agg(F.max("v").alias("v"))


def scan(k: int, window: int, kind: str):
    """Rows (curve, key, asks, e, v) sorted by curve and key -> (q, e, score): each query's ``k`` best among the ``window`` entries
    before it and after it on its curve, as far as this partition goes. ``v`` is bytes of numbers of ``kind``."""
    step = max(256, window)

    def top(qs, xq, es, xe):
        scores = xq @ xe.T
        n = min(k, len(es))
        least = np.partition(scores, len(es) - n, axis=1)[:, len(es) - n]
        i, j = np.nonzero(scores >= least[:, None])
        values = scores[i, j]
        by = np.lexsort((es[j], -values, i))
        i, j, values = i[by], j[by], values[by]
        counts = np.bincount(i, minlength=len(qs))
        first = np.arange(len(i)) - np.repeat(np.cumsum(counts) - counts, counts) < n
        return pa.RecordBatch.from_arrays([pa.array(qs[i[first]]), pa.array(es[j[first]]), pa.array(values[first])], ["q", "e", "score"])

    def curve_runs(batches):
        """(new curve?, asks, e, matrix) of runs of one curve."""
        last = None
        for batch in batches:
            curve = batch.column("curve").to_numpy()
            asks, e = batch.column("asks").to_numpy(zero_copy_only=False), batch.column("e").to_numpy()
            data = batch.column("v")
            x = np.frombuffer(data.buffers()[2], kind)
            d = len(data[0].as_py()) // np.dtype(kind).itemsize
            x = x[data.offset * d : (data.offset + len(data)) * d].reshape(-1, d)
            for at in np.split(np.arange(len(curve)), np.flatnonzero(np.diff(curve)) + 1):
                if len(at):
                    here = slice(at[0], at[-1] + 1)
                    yield curve[at[0]] != last, asks[here], e[here], x[here].astype(np.float64)
                    last = curve[at[0]]

    def score(es, xe, queries, upto):
        """Queries placed before entry ``upto`` of those held, in steps; returns the queries left."""
        place = queries[2]
        for low in range(0, upto, step):
            mine = (place >= low) & (place < min(upto, low + step))
            if mine.any():
                near = slice(max(0, low - window), low + step + window)
                if len(es[near]):
                    yield top(queries[0][mine], queries[1][mine], es[near], xe[near])

    def run(batches):
        es, xe, queries = None, None, None  # entries held, and queries with their places among them
        for new, asks, e, x in curve_runs(batches):
            if new and es is not None:
                yield from score(es, xe, queries, len(es) + 1)
                es = None
            if es is None:
                es, xe, queries = e[:0], x[:0], (e[:0], x[:0], np.zeros(0, np.int64))
            place = len(es) + np.cumsum(~asks) - ~asks
            es, xe = np.concatenate([es, e[~asks]]), np.concatenate([xe, x[~asks]])
            queries = tuple(map(np.concatenate, zip(queries, (e[asks], x[asks], place[asks]))))
            ready = (len(es) - window) // step * step  # their windows are all here
            if ready > 4 * step:
                yield from score(es, xe, queries, ready)
                rest, cut = queries[2] >= ready, max(0, ready - window)
                es, xe, queries = es[cut:], xe[cut:], (queries[0][rest], queries[1][rest], queries[2][rest] - cut)
        if es is not None:
            yield from score(es, xe, queries, len(es) + 1)

    return run


def nearest(vectors: DataFrame, *, every: int = 20, k: int = 20, width: int = 8, target: float = 0.95, sample_rows: int = 4096, partition_rows: int = 65_536, seed: int = 11, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each id divisible by ``every``."""
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = written(valid(vectors, vec_id, embedding), "vectors")
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if sizes is None:
        return empty
    rows = rows.where(F.size("v") == sizes.d)
    first = Window.partitionBy("v").orderBy("id")
    few = rows.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1)  # limited before the shuffle as well
    entries = few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    entries = entries.select(F.col("ids")[0].alias("e"), "v", "ids")
    asking = rows.where(F.col("id") % every == 0)
    asked = asking.select("v").distinct().withColumn("asks", F.lit(True))
    entries = written(entries.join(asked, "v", "left").withColumn("asks", F.coalesce("asks", F.lit(False))), "entries")

    squares = F.aggregate(F.transform("v", lambda x: x.cast("double")), F.lit(0.0), lambda a, x: a + x * x)
    about = entries.agg(F.count(F.lit(1)).alias("n"), F.max(squares).alias("m")).first()
    cut = hash_cut(sample_rows, about.n)
    some = entries if cut is None else entries.where(F.xxhash64("e") <= cut)
    sample = np.array([r.v for r in some.orderBy(F.xxhash64("e"), "e").limit(sample_rows).select("v").collect()], float)
    order = Curves(sample, float(np.sqrt(about.m)), max(CURVES), width, seed)
    curves, share = pick(order, sample, about.n, k, target) if len(sample) > 1 else (CURVES[0], 1.0)
    window = max(k + 1, int(np.ceil(share * about.n)))
    order.keep(curves)
    shared, kind = spark.sparkContext.broadcast(order), "<f4" if dict(rows.dtypes)["v"] == "array<float>" else "<f8"

    def dealt(batches):
        names = ["curve", "key", "asks", "e", "v"]
        for batch in sliced(batches, 1024):
            n, v = batch.num_rows, batch.column("v")
            flat = np.asarray(v.flatten()).astype(kind)
            x, e = flat.reshape(n, -1), batch.column("e").to_numpy()
            data = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * x.shape[1] * x.itemsize).astype("<i4").tobytes()), pa.py_buffer(x.tobytes())])
            mine = np.flatnonzero(batch.column("asks").to_numpy(zero_copy_only=False))
            keys = shared.value.keys(x.astype(float), e)
            asked = shared.value.keys(x[mine].astype(float), e[mine], queries=True)
            for c in range(curves):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, c, np.int32)), pa.array(keys[:, c].copy()), pa.array(np.zeros(n, bool)), batch.column("e"), data], names)
                if len(mine):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(mine), c, np.int32)), pa.array(asked[:, c].copy()), pa.array(np.ones(len(mine), bool)), pa.array(e[mine]), data.take(pa.array(mine))], names)

    placed = entries.select("e", "asks", "v").mapInArrow(dealt, "curve int, key long, asks boolean, e long, v binary")
    total, parts = curves * about.n, int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, min(max(parts, total // partition_rows), total // (16 * window)))
    placed = placed.repartitionByRange(parts, "curve", "key").sortWithinPartitions("curve", "key")
    found = placed.mapInArrow(scan(k + 1, window, kind), "q long, e long, score double")
    found = found.groupBy("q", "e").agg(F.max("score").alias("score"))
    ranked = Window.partitionBy("q").orderBy(F.desc("score"), "e")
    found = found.withColumn("r", F.row_number().over(ranked)).where(F.col("r") <= k + 1).drop("r")

    ids = found.join(entries.select("e", "ids"), "e").select("q", "score", F.explode("ids").alias("vec_id"))
    askers = asking.join(entries.select("v", F.col("e").alias("q")), "v").select("q", F.col("id").alias("query_id"))
    ids = ids.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= k + 1).drop("r")
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = askers.join(ids, "q").where("query_id != vec_id").withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op1(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
