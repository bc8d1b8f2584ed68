"""The trie against one built by hand, of conversations that share, nest, repeat and run long."""

import hashlib
import random
import re
import zlib

import pytest

from siftrock.llm import prefix_trie


def brute(convs):
    """Rows by (conv_id, depth) of conversations id -> [(role, text)]."""
    members, out = {}, {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids, leaves, saved = {}, dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for p in members:
        if p:
            kids[p[:-1]] = kids.get(p[:-1], 0) + 1
    for p, m in members.items():
        own = (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += own
    for p, m in members.items():
        ids = ",".join(str(c) for c in sorted(m) if len(convs[c]) == len(p))
        out[min(m), len(p)] = (min(members[p[:-1]]) if p else None, len(m), kids.get(p, 0), leaves[p], saved[p], hashlib.sha256(ids.encode()).hexdigest())
    return out


def rows_of(convs, rng):
    rows = [(c, i if i else None, *t) for c, turns in convs.items() for i, t in enumerate(turns)]
    rng.shuffle(rows)
    return rows


def same(got, want):
    assert {(r.conv_id, r.depth): tuple(r[2:]) for r in got} == want and len(got) == len(want)


@pytest.fixture(params=[8, 1])
def block(request, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", request.param)  # carries over many blocks of two turns, too
    monkeypatch.setattr(prefix_trie, "CHUNK", request.param)


def some_conversations(rng):
    said = [(r, t) for r in ("user", "assistant", "") for t in ("", "a", "b c", "é \n x\x0by")]
    convs = {i * 7 - 50: [rng.choice(said) for _ in range(rng.randint(1, 5))] for i in range(150)}
    convs |= {1000 + i: [said[j % 5] for j in range(i + 1)] for i in range(40)}  # each begins the next: pointers from run to run
    convs |= {3000 - i: [said[j % 5] for j in range(i + 1)] for i in range(30, 60)}
    convs[5000] = [said[j % 11] for j in range(600)]
    convs[5001] = convs[5000][:599] + [("user", "other")]
    return convs


def test_against_brute_force(spark, block):
    rng = random.Random(3)
    convs = some_conversations(rng)
    df = spark.createDataFrame([(*r, "x") for r in rows_of(convs, rng)], "conv_id long, turn long, role string, text string, depth string")
    same(prefix_trie.conversation_trie(df.unionAll(df.limit(5).selectExpr("NULL", "turn", "role", "text", "depth"))).collect(), brute(convs))


def test_shared_beginnings_against_brute_force(spark, block):
    rng = random.Random(4)
    convs = {c: [(rng.choice("ua"), f"{c % 20} {i % 2}") for i in range(rng.randint(1, 6))] for c in [*range(60), *range(100, 120), *range(121, 140), 10**12]}
    rebuilt = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = convs.get(c - c % 20, [])[:h] + turns[h:]
    assert not all(rebuilt.values())  # some have no turns
    df = spark.createDataFrame(rows_of(convs, rng), "conv_id long, turn long, role string, text string")
    same(prefix_trie.trie(*prefix_trie.shared_beginnings(df)).collect(), brute(rebuilt))


def test_ties_nulls_and_no_rows(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert prefix_trie.conversation_trie(spark.createDataFrame([], schema)).collect() == []
    rows = [(1, 5, None, None), (1, 5, "u", "x y"), (1, 5, "u", "x y"), (2, 7, "u", "x y"), (2, 7, "", ""), (2, 7, "u", "x y")]
    got = {(r.conv_id, r.depth): r for r in prefix_trie.conversation_trie(spark.createDataFrame(rows, schema)).collect()}
    assert sorted(got) == [(1, 0), (1, 1), (1, 2), (1, 3)]  # the order of equal turns depends on what they say alone
    assert all(r.n_convs == 2 for r in got.values()) and got[1, 0].saved_tokens == 4
    assert got[1, 3].ends_sha256 == hashlib.sha256(b"1,2").hexdigest() and got[1, 2].ends_sha256 == prefix_trie.NOTHING
