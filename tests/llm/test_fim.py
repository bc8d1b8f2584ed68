"""Cuts by rank and select against cuts of Python strings, and the exact way back."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftrock.llm import fim


def test_rank_and_select_against_counting():
    rng = np.random.default_rng(3)
    for n, share in ((0, 0.5), (1, 1.0), (63, 0.5), (64, 1.0), (65, 0.0), (512, 1.0), (513, 0.3), (5000, 0.02), (70_000, 0.97)):
        ones = rng.random(n) < share
        bits, places = fim.Bits(ones), np.flatnonzero(ones)
        at = np.arange(n + 1)
        assert (bits.rank(at) == np.concatenate([[0], np.cumsum(ones)])).all()
        assert (bits.select(np.arange(len(places))) == places).all()


def plain(doc_id, text, percent, spm, seed, marks):
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in marks) or h[2] % 100 >= percent:
        return n, "plain", None, None, text
    p, s, m = marks
    if h[3] % 100 < spm:
        return n, "spm", a, b - a, s + text[b:] + p + text[:a] + m + text[a:b]
    return n, "psm", a, b - a, p + text[:a] + s + text[b:] + m + text[a:b]


@pytest.mark.parametrize("marks, percent, spm, seed", [(fim.MARKS, 90, 20, 1), (("<|pre|>", "<|suf|>", "<|mid|>"), 100, 50, 7), (("❶", "❷", "❸"), 50, 100, 2)])
def test_against_cuts_of_strings(spark, marks, percent, spm, seed):
    rng = random.Random(4)
    letters = "ab <PSM>é字🎈\ń‍❶"
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(900)] + [None, "", "a", "🎈", "<P", "x<P>y", "<S", "é" * 300_000, "🎈x" * 70_000]
    rows = [(i if i % 50 else None, t, i) for i, t in enumerate(texts)] + [(3, texts[3], 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, place int").withColumn("N", F.lit("other")).withColumn("first", F.lit(1.5))
    got = fim.fill_in_middle(df, percent=percent, spm_percent=spm, seed=seed, marks=marks).withColumn("back", fim.restored(F.col("output"), F.col("form"), marks)).collect()
    assert len(got) == len(rows) and {r.first for r in got} == {1.5}
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain(r.doc_id, r.text, percent, spm, seed, marks)
        assert r.back == (r.text or "")
    assert {r.form for r in got} >= {"plain", "spm"}


def test_empty_table_and_bad_marks(spark):
    got = fim.fill_in_middle(spark.createDataFrame([], "doc_id long, text string, n int"))
    assert got.columns == ["doc_id", "text", *fim.RESULT] and got.count() == 0
    for marks in (("<P>", "<P>", "<M>"), ("", "a", "b"), ("aba", "x", "y"), ("<P", "P>", "M"), ("ab", "xaby", "z")):
        with pytest.raises(ValueError):
            fim.fill_in_middle(spark.createDataFrame([], "doc_id long, text string"), marks=marks)
