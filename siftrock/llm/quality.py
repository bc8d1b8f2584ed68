"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. Each passage is encoded (one tanh layer over its
features), gated attention weighs the passages, and a logistic unit scores the weighted mean. Encoder,
attention and scorer are trained together from document labels alone, by Adam in numpy on a
bounded sample of labelled documents (``train_rows``); a quarter of it calibrates the scores (Platt).

Features describe form, not words: shares of character classes, word lengths, repetition within the
passage, and repetition of lines and words over the document.

Defined results: null and empty texts are a single passage of zeros and get a score like any. Where
the labels don't hold both kinds, the score is the smoothed rate of label 1 and nothing is rejected by ``keep``.
Documents whose labels disagree count by their mean. Repeated rows are scored each. Whole texts are read.
"""

from __future__ import annotations

import functools
import operator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import hash_cut, held_out, sliced

PASSAGE, THRESHOLD = 64, 0.7
RESULT = "doc_id long, held_out boolean, score double, predicted int"
N_CLASSES = 8


@functools.cache
def _classes() -> np.ndarray:
    """Byte classes: 0 lower-case and non-ASCII letters, 1 upper case, 2 digits, 3 space, 4 sentence marks, 5 quotes and brackets, 6 bars and marks of markup, 7 the rest."""
    table = np.full(256, 7, np.uint8)
    table[128:] = 0
    for k, chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", ".,;:!?", "\"'()[]{}-", "|<>=_\\/")):
        table[np.frombuffer(chars.encode(), np.uint8)] = k
    return table


def passages(text: str | None) -> np.ndarray:
    """A row of features for each passage."""
    text = text or ""
    words = text.split()
    n = len(words)
    if not n:
        return np.zeros((1, WIDTH), np.float32)
    data = np.frombuffer((" ".join(words) + " ").encode("utf-8", "surrogatepass"), np.uint8)
    kind = _classes()[data]
    ends = np.flatnonzero(kind == 3)
    size = np.diff(ends, prepend=-1) - 1.0
    first = np.arange(0, n, PASSAGE)
    starts = np.concatenate([[0], ends[first[1:] - 1] + 1])
    total = np.diff(np.append(starts, len(data))).astype(float)
    counts = np.stack([np.add.reduceat(kind == k, starts, dtype=np.int32) for k in range(N_CLASSES)], 1)
    shares = counts / total[:, None]
    per = np.diff(np.append(first, n)).astype(float)
    mean = np.add.reduceat(size, first) / per
    spread = np.sqrt(np.maximum(np.add.reduceat(size**2, first) / per - mean**2, 0))
    marked = np.add.reduceat(np.isin(kind[np.maximum(ends - 1, 0)], (5, 6, 7)).astype(float), first) / per
    stopped = np.add.reduceat((kind[np.maximum(ends - 1, 0)] == 4).astype(float), first) / per
    distinct, again, top = [], [], []
    for a in first.tolist():
        w = words[a : a + PASSAGE]
        distinct.append(len(set(w)) / len(w))
        again.append(sum(map(operator.eq, w, w[1:])) / len(w))
        top.append(len(set(zip(w, w[1:], strict=False))) / max(1, len(w) - 1))
    lines = [x for x in text.split("\n") if x]
    whole = [
        len(set(lines)) / max(1, len(lines)),
        len(set(words)) / n,
        np.log1p(n) / 10,
        np.log1p(n / max(1, len(lines))) / 5,
        len(set(zip(words, words[1:], strict=False))) / max(1, n - 1),
    ]
    out = np.column_stack([shares, mean / 10, np.minimum(spread, 20) / 10, np.minimum(size_max(size, first), 60) / 20, marked, stopped, distinct, again, top, per / PASSAGE, np.tile(whole, (len(first), 1))])
    return out.astype(np.float32)


def size_max(size: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.maximum.reduceat(size, first)


WIDTH = N_CLASSES + 9 + 5


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class AttentionModel:
    """Parameters: e, f encoder; v, u, w gated attention; c, b scorer; a, d Platt's line; mean, sd of the features."""

    def __init__(self, rate: float, params: dict | None = None):
        self.rate, self.p = rate, params

    def forward(self, x: np.ndarray, bag: np.ndarray):
        """x: passages; bag: index of each document's first passage."""
        p = self.p
        h = np.tanh((x - p["mean"]) / p["sd"] @ p["e"] + p["f"])
        t, g = np.tanh(h @ p["v"]), _sigmoid(h @ p["u"])
        s = (t * g) @ p["w"]
        counts = np.diff(np.append(bag, len(x)))
        s = s - np.repeat(np.maximum.reduceat(s, bag), counts)
        a = np.exp(s)
        a /= np.repeat(np.add.reduceat(a, bag), counts)
        z = np.add.reduceat(a[:, None] * h, bag, axis=0)
        return h, t, g, a, z, z @ p["c"] + p["b"], counts

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not self.p:
            return np.full(len(texts), self.rate)
        bags = [passages(t) for t in texts]
        sizes = [len(b) for b in bags]
        if not bags:
            return np.zeros(0)
        logit = self.forward(np.concatenate(bags), np.concatenate([[0], np.cumsum(sizes)[:-1]]))[5]
        return _sigmoid(self.p["a"] * logit + self.p["d"])


def fit(bags: list[np.ndarray], y: np.ndarray, *, hidden: int = 16, gates: int = 8, epochs: int = 60, batch: int = 64, rate: float = 0.01, decay: float = 1e-4, seed: int = 3) -> AttentionModel:
    base = float((y.sum() + 1) / (len(y) + 2)) if len(y) else 0.5
    if len(np.unique(y >= 0.5)) < 2 or len(y) < 20:
        return AttentionModel(base)
    rng = np.random.default_rng(seed)
    later = np.arange(len(y)) % 4 == 3
    learn, check = np.flatnonzero(~later), np.flatnonzero(later)
    flat = np.concatenate([bags[i] for i in learn])
    n = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    p = {"e": n(WIDTH, hidden), "f": np.zeros(hidden), "v": n(hidden, gates), "u": n(hidden, gates), "w": n(gates), "c": n(hidden), "b": np.zeros(()), "a": 1.0, "d": 0.0}
    p |= {"mean": flat.mean(0), "sd": flat.std(0) + 1e-3}
    model = AttentionModel(base, p)
    trained = ("e", "f", "v", "u", "w", "c", "b")
    m1, m2, step = {k: np.zeros_like(p[k]) for k in trained}, {k: np.zeros_like(p[k]) for k in trained}, 0
    for epoch in range(epochs):
        rng.shuffle(learn)
        for at in range(0, len(learn), batch):
            some = learn[at : at + batch]
            x = np.concatenate([bags[i] for i in some])
            bag = np.concatenate([[0], np.cumsum([len(bags[i]) for i in some])[:-1]])
            h, t, g, a, z, logit, counts = model.forward(x, bag)
            out = (_sigmoid(logit) - y[some]) / len(some)
            grad = {"c": z.T @ out, "b": out.sum()}
            dz = np.repeat(out[:, None] * p["c"], counts, axis=0)
            da = (h * dz).sum(1)
            ds = a * (da - np.repeat(np.add.reduceat(a * da, bag), counts))
            grad["w"] = (t * g).T @ ds
            both = ds[:, None] * p["w"]
            dt, dg = both * g * (1 - t * t), both * t * g * (1 - g)
            grad["v"], grad["u"] = h.T @ dt, h.T @ dg
            dh = (a[:, None] * dz + dt @ p["v"].T + dg @ p["u"].T) * (1 - h * h)
            grad["e"], grad["f"] = ((x - p["mean"]) / p["sd"]).T @ dh, dh.sum(0)
            step += 1
            for k in trained:
                d = grad[k] + decay * p[k]
                m1[k] = 0.9 * m1[k] + 0.1 * d
                m2[k] = 0.999 * m2[k] + 0.001 * d * d
                p[k] = p[k] - rate * (1 - epoch / epochs) * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    x = np.concatenate([bags[i] for i in check])
    logit = model.forward(x, np.concatenate([[0], np.cumsum([len(bags[i]) for i in check])[:-1]]))[5]
    a, d, target = 1.0, 0.0, y[check] * (1 - 2 / (len(check) + 4)) + 1 / (len(check) + 4)
    for _ in range(300):  # Platt's line, by gradient with a slight pull towards none
        q = _sigmoid(a * logit + d) - target
        a -= 0.05 * ((q * logit).mean() + 0.01 * (a - 1))
        d -= 0.3 * q.mean()
    p |= {"a": float(max(a, 0.05)), "d": float(d)}
    return model


def train(docs: DataFrame, labels: DataFrame, *, train_rows: int = 3000, doc_id: str = "doc_id", text: str = "text", label: str = "quality", **options) -> AttentionModel:
    """A model from at most ``train_rows`` labelled documents that aren't held out. Half are taken from either label as far as there are such."""
    marks = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull() & ~held_out(doc_id)).groupBy(F.col(doc_id).alias("_id")).agg(F.avg(label).alias("_y"))
    counts = marks.agg(F.count(F.when(F.col("_y") < 0.5, 1)).alias("n0"), F.count(F.when(F.col("_y") >= 0.5, 1)).alias("n1")).first()

    def smallest(some: DataFrame, total: int) -> DataFrame:
        cut = hash_cut(train_rows // 2, total)
        return (some if cut is None else some.where(F.xxhash64("_id") <= cut)).orderBy(F.xxhash64("_id"), "_id").limit(train_rows // 2)

    chosen = F.broadcast(smallest(marks.where("_y < 0.5"), counts.n0).unionAll(smallest(marks.where("_y >= 0.5"), counts.n1)))  # bounded by train_rows
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))  # no other column can clash
    some = texts.join(chosen, F.col("doc_id") == F.col("_id")).select("_id", "_y", "text")

    def encode(batches):
        for batch in sliced(batches):
            bags = [passages(t).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_id").cast(pa.int64()), batch.column("_y"), pa.array(bags, pa.binary())], ["_id", "_y", "bag"])

    rows = some.mapInArrow(encode, "_id long, _y double, bag binary").limit(2 * train_rows).collect()
    rows = sorted(rows, key=lambda r: (hash_order(r._id), r._id, bytes(r.bag)))
    model = fit([np.frombuffer(bytes(r.bag), np.float32).reshape(-1, WIDTH) for r in rows], np.array([r._y for r in rows]), **options)
    took = np.array([r._y >= 0.5 for r in rows])
    if model.p and counts.n0 and counts.n1:  # the sample is even; the labels aren't: move the line by the difference in log odds
        model.p["d"] += float(np.log(counts.n1 / counts.n0) - np.log(took.sum() / max(1, (~took).sum())))
    return model


def hash_order(i: int) -> int:
    return (i * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 20


def score(docs: DataFrame, model: AttentionModel, *, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers

    def run(batches):
        for some in sliced(batches):
            s = shared.value.score(some.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [some.column("doc_id"), some.column("held_out"), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), held_out(doc_id).alias("held_out"))
    return rows.mapInArrow(run, RESULT)


def keep(docs: DataFrame, model: AttentionModel, *, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """``docs`` without the rows that the model rejects; all, if nothing could be learned."""
    if not model.p:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for some in sliced(batches):
            yield some.filter(pa.array(shared.value.score(some.column(text).to_pylist()) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op9(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return score(docs, train(docs, labels))
