"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text is letters in lower case; everything else is a border. Its subwords are the runs of one to
four letters with the borders beside them, hashed into ``BUCKETS``. A text's vector is the mean of its subwords'
embeddings; a linear softmax on it gives the languages. Both are trained by stochastic gradient descent in
numpy on a bounded sample of labelled documents (``train_rows``); a quarter of the sample sets the temperature and
the score below which a prediction is rejected. As everything before the softmax is linear, a prediction needs only
the product of both matrices: one small row of logits per bucket.

Defined results: null texts, and texts without letters, are ``und`` with score 0. Without labelled documents so
are all. Repeated rows are predicted each; null ids are never held out and never learned from. Whole texts are read.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import held_out, sliced

BUCKETS, LONGEST = 1 << 14, 4
RESULT = "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean"


@functools.cache
def _letters() -> np.ndarray:
    """The lower-case code point of every letter, 0 for all else."""
    table = np.zeros(0x110000, np.uint32)
    for c in range(len(table)):
        ch = chr(c)
        if ch.isalpha():
            table[c] = ord(ch.lower()[0])
    return table


def subwords(text: str | None) -> np.ndarray:
    """The bucket of every subword."""
    m = _letters()[np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4")]
    if not m.any():
        return np.zeros(0, np.int64)
    m = np.pad(m, 1)
    letter, out = m != 0, []
    h = m * np.uint32(0x9E3779B1)
    whole, inner = h, letter
    for n in range(1, LONGEST + 1):
        size = len(m) - n + 1
        if size <= 0:
            break
        if n > 1:
            whole = (whole[:size] ^ (whole[:size] >> np.uint32(15))) * np.uint32(0x85EBCA77) + h[n - 1 :]
        if n == 1:
            ok = letter
        elif n == 2:
            ok = letter[:size] | letter[1:]
        else:
            inner = letter[1 : size + 1] if n == 3 else inner[:size] & letter[n - 2 : size + n - 2]
            ok = inner
        key = whole[:size][ok]
        key = (key ^ (key >> np.uint32(13))) * np.uint32(0xC2B2AE3D + 2 * n)
        out.append(key >> np.uint32(18))
    return np.concatenate(out).astype(np.int64)


class LanguageModel:
    def __init__(self, langs: list[str], table: np.ndarray, bias: np.ndarray, temperature: float, reject: float):
        self.langs, self.table, self.bias, self.temperature, self.reject = langs, table.astype(np.float32), bias, temperature, reject

    def logits(self, buckets: np.ndarray) -> np.ndarray:
        if len(buckets) > BUCKETS:
            total = np.bincount(buckets, minlength=BUCKETS).astype(np.float32) @ self.table
        else:
            total = self.table[buckets].sum(0)
        return total / len(buckets) + self.bias

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        buckets = subwords(text)
        if not len(buckets) or not self.langs:
            return "und", 0.0, False
        p = softmax(self.logits(buckets) / self.temperature)
        k = int(np.argmax(p))
        return self.langs[k], float(min(1.0, p[k])), bool(p[k] >= self.reject)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], *, width: int = 16, epochs: int = 12, rate: float = 0.5, seed: int = 7, precision: float = 0.99) -> LanguageModel:
    """rows: (language, buckets, their counts). Stochastic gradient descent, a document at a time, at a falling rate."""
    rows = [r for r in rows if len(r[1])]
    langs = sorted({r[0] for r in rows})
    if not langs:
        return LanguageModel([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, 1.0)
    rng = np.random.default_rng(seed)
    y = np.array([langs.index(r[0]) for r in rows])
    x = [(r[1], (r[2] / r[2].sum()).astype(np.float32)) for r in rows]
    later = np.arange(len(rows)) % 4 == 3
    learn, check = np.flatnonzero(~later), np.flatnonzero(later)
    e = rng.normal(0, 0.1, (BUCKETS, width)).astype(np.float32)
    w = rng.normal(0, 0.1, (width, len(langs))).astype(np.float32)
    b = np.zeros(len(langs), np.float32)
    steps = epochs * len(learn)
    for t in range(steps):
        if t % len(learn) == 0:
            rng.shuffle(learn)
        i = learn[t % len(learn)]
        idx, val = x[i]
        lr = np.float32(rate * (1 - t / steps))
        hidden = val @ e[idx]
        g = softmax(hidden @ w + b)
        g[y[i]] -= 1
        back = w @ g
        w -= lr * np.outer(hidden, g)
        b -= lr * g
        e[idx] -= (lr * 20 * val)[:, None] * back  # a mean spreads its gradient thinly over many buckets
    table = e @ w
    model = LanguageModel(langs, table, b, 1.0, 0.0)
    if len(check):
        z = np.array([x[i][1] @ table[x[i][0]] + b for i in check])
        grid = np.geomspace(0.05, 10, 60)
        nll = [-np.log(softmax(z / t)[np.arange(len(check)), y[check]] + 1e-12).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(nll))])
        p = softmax(z / model.temperature)
        order = np.argsort(-p.max(1), kind="stable")
        right = (p.argmax(1) == y[check])[order]
        good = np.flatnonzero(np.cumsum(right) / np.arange(1, len(right) + 1) >= precision)
        model.reject = float(p.max(1)[order][good[-1]]) if len(good) else 1.0
    return model


def train(docs: DataFrame, *, train_rows: int = 2400, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", **options) -> LanguageModel:
    """A model from at most ``train_rows`` documents that aren't held out, shared out evenly between the languages."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))  # no other column can clash
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id")).select(F.col("doc_id").alias("_id"), "lang")
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    n_langs = F.lit(max(1, sizes.count()))
    chance = F.abs(F.xxhash64("_id") % 1_000_003) / 1_000_003
    ids = known.join(sizes, "lang").where(chance <= 1.3 * train_rows / n_langs / F.col("n"))
    ids = ids.orderBy(F.xxhash64("_id"), "_id").select("_id").limit(train_rows).distinct()  # bounded, so it may be broadcast
    some = docs.where(F.col("lang").isNotNull()).join(F.broadcast(ids), F.col("doc_id") == F.col("_id"), "left_semi")

    def features(batches):
        for batch in sliced(batches):
            out = [np.unique(subwords(t), return_counts=True) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([o[0].tolist() for o in out], pa.list_(pa.int32())), pa.array([o[1].tolist() for o in out], pa.list_(pa.int32()))],
                ["_id", "_lang", "b", "c"],
            )

    rows = some.select(F.col("doc_id").cast("long"), "text", "lang").mapInArrow(features, "_id long, _lang string, b array<int>, c array<int>")
    rows = sorted(rows.limit(2 * train_rows).collect(), key=lambda r: (r._id, r._lang, r.b))
    return fit([(r._lang, np.array(r.b, np.int64), np.array(r.c, float)) for r in rows], **options)


def identify(docs: DataFrame, model: LanguageModel, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS rows, a number for each language

    def run(batches):
        for batch in sliced(batches):
            got = [shared.value.predict(t) for t in batch.column("text").to_pylist()]
            cols = list(zip(*got, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.bool_())],
                ["doc_id", "held_out", "lang_pred", "score", "accepted"],
            )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), held_out(doc_id).alias("held_out"))
    return rows.mapInArrow(run, RESULT)


def op3(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return identify(docs, train(docs))
