"""The join of sets against all pairs."""

import random

import numpy as np
import pytest

from siftrock.llm import set_join


def plain_set(text, words):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return frozenset([tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))]) if w else frozenset()


def plain_components(sets, percent):
    ids, root = sorted(sets), {}
    for i in ids:
        if i not in root:
            todo, root[i] = [i], i
            while todo:
                a = todo.pop()
                for b in ids:
                    if b not in root and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                        root[b] = i
                        todo.append(b)
    return root


def texts(rng, most):
    vocabulary = ["".join(rng.choices("abcd", k=4)) for _ in range(200)]
    base = [rng.choices(vocabulary, k=rng.randint(1, most)) for _ in range(40)]
    out = [None, "", " \n", "x", "X", "x y", "X\ty", "x y z", "x y z x y z x y z"]
    for _ in range(420):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 1 + len(w) // 25)):
            at = rng.randrange(len(w))
            w[at : at + rng.randint(0, 1)] = [rng.choice(vocabulary)] * rng.randint(0, 2)
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("words, percent, expected, most", [(3, 90, None, 160), (3, 90, 10**12, 60), (1, 80, 10**6, 90), (2, 50, 10**9, 12)])
def test_against_all_pairs(spark, monkeypatch, words, percent, expected, most):
    monkeypatch.setattr(set_join, "MEMBERS", 16)  # keys of several blocks
    some = texts(random.Random(most), most)
    rows = [(i, t, i) for i, t in enumerate(some)]
    df = spark.createDataFrame(rows, "doc_id long, text string, node int")
    got = set_join.similar_sets(df, words=words, percent=percent, expected=expected).collect()
    sets = {i: plain_set(t, words) for i, t in enumerate(some)}
    assert {r.doc_id: r.n_shingles for r in got} == {i: len(s) for i, s in sets.items()} and len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got} == plain_components(sets, percent)


def test_pairs_within_the_budget_share_a_key_that_neither_leaves_out():
    rng = np.random.default_rng(5)
    kinds = set()
    for sets in (10**3, 10**7, 10**11):
        for n in [*range(9, 40), 60, 100, 150, 400, 1000]:
            for _ in range(12):
                whole = np.unique(rng.integers(0, 2**63, n, np.uint64))
                out = int(rng.integers(0, set_join.allowed(2 * n, 90) + 1))
                other = np.unique(np.concatenate([np.delete(whole, rng.permutation(n)[:out]), rng.integers(0, 2**63, int(rng.integers(0, out + 1)), np.uint64)]))
                a, b = (set_join.signature(x, 90, sets, 4) for x in (whole, other))
                differ = len(np.setxor1d(whole, other))
                if 0 < differ <= set_join.allowed(len(whole) + len(other), 90):
                    shared = [(a[1], b[1], a[3]), (a[1], b[2], a[3]), (a[2], b[1], b[3])]  # of one at home with one at home or a visitor
                    assert any(len(np.intersect1d(x, y)) > out for x, y, out in shared)  # more than either leaves out
                x, y = (np.frombuffer(s[0], np.uint8) for s in (a, b))
                assert np.bitwise_count(x ^ y).sum() <= differ
        kinds |= {set_join.band(k, 90, sets, 4)[2][1:] for k in range(6, 40) if set_join.band(k, 90, sets, 4)[2]}
    assert {k[1] for k in kinds} == {True, False} and {k[0] for k in kinds} >= {0, 1, 2}


def test_nulls_repeated_rows_and_no_rows(spark):
    schema = "doc_id long, text string"
    assert set_join.similar_sets(spark.createDataFrame([], schema)).collect() == []
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(None, "a b c d"), (7, "A b c d"), (7, "a b c d"), (None, None), (9, ""), (9, ""), (3, long), (4, long + " end"), (None, "q")]
    got = sorted((tuple(r) for r in set_join.similar_sets(spark.createDataFrame(rows, schema), words=3, percent=90).collect()), key=repr)
    want = [(None, 2, 7), (7, 2, 7), (7, 2, 7), (None, 0, None), (9, 0, 9), (9, 0, 9), (3, 59_998, 3), (4, 59_999, 3), (None, 1, None)]
    assert got == sorted(want, key=repr)
