"""SimHash components and string tiling against plain versions that compare everything with everything."""

import random
import time

import numpy as np
import pytest
import xxhash

from siftrock.llm import simhash, tiling

random.seed(5)
VOCABULARY = ["".join(random.choices("abcdefgh", k=5)) for _ in range(300)]


def prose(n):
    return " ".join(random.choices(VOCABULARY, k=n))


def changed(text, times):
    words = text.split()
    for _ in range(times):
        words[random.randrange(len(words))] = random.choice(VOCABULARY)
    return " ".join(words)


def plain_print(text, words):
    w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()]
    if not w:
        return 0
    shingles = [" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def plain_components(prints):
    """Smallest id reachable over links of at most four bits; prints: id -> fingerprint."""
    ids, root = sorted(prints), {}
    for i in ids:
        if i not in root:
            todo, root[i] = [i], i
            while todo:
                a = todo.pop()
                for b in ids:
                    if b not in root and (prints[a] ^ prints[b]).bit_count() <= 4:
                        root[b] = i
                        todo.append(b)
    return root


def test_components_against_all_pairs(spark):
    base = [prose(random.randint(60, 200)) for _ in range(12)]
    texts = base + [changed(random.choice(base), random.randint(0, 4)) for _ in range(120)] + [None, "", "one two", "ONE  two\n", "é É"]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash.near_duplicates(df, words=4).collect()
    prints = {i: plain_print(t, 4) for i, t in rows}
    assert {r.doc_id: int(r.fingerprint, 16) for r in got} == prints
    assert {r.doc_id: r.component_id for r in got} == plain_components(prints)


def test_any_four_bits_leave_a_key_and_pass_the_chains(spark):
    from itertools import combinations

    masks = simhash.key_masks(list(range(64)))
    assert len(masks) == 70 and all(m.bit_count() == 32 for m in masks)
    some = [sum(1 << b for b in bits) for n in range(5) for bits in combinations(range(0, 64, 3), n)]
    assert all(any(not d & m for m in masks) for d in some)
    rng = random.Random(2)
    far = [sum(1 << b for b in rng.sample(range(64), 5)) for _ in range(300)]
    df = spark.createDataFrame([(simhash._signed(d), d.bit_count() <= 4) for d in some + far], "d long, near boolean")
    assert df.where(f"near != ({simhash.ring_test('d', '0L')})").count() == 0


def test_one_plan_for_many_fingerprints(spark):
    """70 keys a fingerprint whatever their number; of random ones hardly any key is shared, so nothing else grows."""
    n = 200_000
    fps = spark.range(n).selectExpr("xxhash64(id) AS fp").unionAll(spark.range(0, n, 1000).selectExpr("xxhash64(id) ^ 7L AS fp")).distinct()
    fps = simhash.written(fps, "many")
    got = {tuple(r) for r in simhash.links(fps).collect()}
    want = {tuple(sorted((r.fp, r.fp ^ 7))) for r in spark.range(0, n, 1000).selectExpr("xxhash64(id) AS fp").collect()}
    assert want <= got and len(got) < len(want) + 10


@pytest.mark.parametrize("broadcast_keys", [0, 10**6])
def test_links_reach_exactly_four_bits(spark, broadcast_keys):
    center, rng = random.getrandbits(64), random.Random(1)
    prints = {0: center}
    for i in range(1, 60):
        bits = rng.sample(range(64), rng.choice([1, 2, 3, 4, 5, 6]))
        prints[i] = rng.choice(list(prints.values())) ^ sum(1 << b for b in bits)
    df = spark.createDataFrame([(i, simhash._signed(v)) for i, v in prints.items()], "doc_id long, fp long")
    ids = {r.fp: r.component_id for r in simhash.classes(df, broadcast_keys=broadcast_keys).collect()}
    assert {i: ids[simhash._signed(v)] for i, v in prints.items()} == plain_components(prints)


def test_keeping_one_of_each(spark):
    text = prose(80)
    rows = [(4, text, "x"), (2, text, "y"), (2, text, "y"), (None, text, "z"), (9, prose(80), "w"), (7, None, "v")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = simhash.keep_one(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got.collect()) == [(False, 2), (False, 7), (False, 9), (True, 0)]
    assert simhash.keep_one(df.limit(0)).collect() == []


@pytest.mark.parametrize("similar", [None, 0.8])
def test_ids_repeated_with_other_texts_keep_a_row_of_each_component(spark, similar):
    a, b, c = prose(80), prose(80), prose(80)
    rows = [(1, a), (5, a), (5, b), (5, b), (8, c), (8, a), (9, c)]
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id int, text string"), similar=similar).collect()
    assert sorted(map(tuple, got)) == sorted([(1, a), (5, b), (8, c)])
    got = simhash.keep_one(spark.createDataFrame([(5, a), (5, b)], "doc_id int, text string"), similar=similar).collect()
    assert sorted(map(tuple, got)) == sorted([(5, a), (5, b)])


def plain_similar(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in ((t or "").lower().split() for t in (a, b)))
    return len(a & b) >= 0.8 * len(a | b)


def plain_groups(texts):
    """Component by position, linked by all pairs of a Jaccard similarity of 0.8 or more."""
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and plain_similar(texts[i], texts[j]):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return root


def test_similar_texts_against_all_pairs(spark):
    rng = random.Random(9)
    texts = []
    for _ in range(60):  # up to six words of 150 to 250 replaced: near 0.8 and on either side of it
        base = [rng.choice(VOCABULARY) for _ in range(rng.randint(150, 250))]
        texts.append(" ".join(base))
        for _ in range(3):
            w = list(base)
            for at in rng.sample(range(len(w)), rng.randint(1, 6)):
                w[at] = "x" + rng.choice(VOCABULARY)
            texts.append(" ".join(w))
    texts += [None, "", "a b", "A  b", "a b c"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {i for i, r in enumerate(plain_groups(texts)) if r == i}
    got = {r.doc_id for r in simhash.keep_one(docs, words=5, similar=0.8).collect()}
    assert want <= got and len(got - want) <= 3  # precision is exact; recall on pairs about the threshold
    assert len(want) < 0.6 * len(texts)


@pytest.mark.parametrize("few", [3, 8, 64])
def test_similar_texts_of_a_large_group(spark, monkeypatch, few):
    """A chain of copies whose ends are unlike each other, and others that share its arcs: all pairs, though one per key comes first."""
    monkeypatch.setattr(simhash, "FEW", few)
    rng = random.Random(3)
    w = [rng.choice(VOCABULARY) for _ in range(200)]
    texts = []
    for i in range(90):
        texts.append(" ".join(w))
        w[(i * 7) % 200] = "y" + rng.choice(VOCABULARY)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id for r in simhash.keep_one(docs, words=5, similar=0.8).collect()}
    assert got == {i for i, r in enumerate(plain_groups(texts)) if r == i} == {0}


def plain_tiles(item, doc, k):
    """The textbook: of all unmarked common runs take the longest, again and again."""
    in_item, in_doc, out = set(), set(), []
    while True:
        best = None
        for t in range(len(item)):
            for p in range(len(doc)):
                n = 0
                while t + n < len(item) and p + n < len(doc) and item[t + n] == doc[p + n] and t + n not in in_item and p + n not in in_doc:
                    n += 1
                if n >= k and (best is None or (-n, t, p) < best):
                    best = (-n, t, p)
        if best is None:
            return out
        n, t, p = -best[0], best[1], best[2]
        out.append((n, t, p))
        in_item |= set(range(t, t + n))
        in_doc |= set(range(p, p + n))


def test_tiles_are_those_of_the_textbook():
    rng = np.random.default_rng(6)
    for letters in (1, 2, 3, 8):
        for _ in range(40):
            item, doc = rng.integers(0, letters, rng.integers(1, 25)), rng.integers(0, letters, rng.integers(1, 40))
            k = int(rng.integers(1, 4))
            assert tiling.tile(item, doc, k) == plain_tiles(item.tolist(), doc.tolist(), k)


def test_repetitive_texts_take_time_in_proportion():
    index = tiling.Index([(1, "a " * 400), (2, "b c " * 200)], 4)
    began = time.time()
    for n in (2_000, 50_000):
        assert [x[1:3] for x in tiling.held_items(index, "a " * n, 0.5)] == [(400, 400)]
    assert [x[:3] for x in tiling.held_items(index, "c b " * 25_000, 0.5)] == [(1, 400, 400)]
    assert time.time() - began < 5


def test_tiling_against_the_textbook(spark):
    items = [(i, prose(random.randint(2, 40))) for i in range(12)] + [(50, None), (51, "..."), (52, "a b")]
    docs = []
    for i in range(60):
        parts = []
        for _ in range(random.randint(0, 3)):
            w = random.choice(items[:12])[1].split()
            cut = random.randrange(len(w))
            parts += [w[cut:], random.choices(VOCABULARY, k=4), w[:cut]]
        docs.append((i, " ".join(x for p in parts for x in p).title()))
    docs += [(100, None), (101, ""), (102, "A, b!")]
    got = tiling.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_chars=400)
    want = set()
    for i, d in docs:
        for j, t in items:
            item, doc = tiling.tokens(t), tiling.tokens(d)
            tiles = plain_tiles(item, doc, min(4, len(item))) if item else []
            covered = sum(x[0] for x in tiles)
            if item and covered >= 0.5 * len(item):
                want.add((i, j, covered, len(item), max(x[0] for x in tiles)))
    assert {(r.doc_id, r.item_id, r.covered, r.item_tokens, r.longest) for r in got.collect()} == want


def test_decontamination_keeps_columns(spark):
    docs = spark.createDataFrame([(1, "the quick brown fox jumps", 3), (2, "else", 4), (3, None, 5), (1, "the quick brown fox jumps", 3)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(7, "Quick brown fox jumps")], "item_id long, text string")
    got = tiling.decontaminate(docs, items)
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == [2, 3]
    assert tiling.decontaminate(docs, items.limit(0)).count() == 4
    more = spark.createDataFrame([(7, "Quick brown fox jumps"), (8, "one two three four five"), (9, "else")], "item_id long, text string")
    assert [r.doc_id for r in tiling.decontaminate(docs, more, block_chars=20).collect()] == [3]
    assert tiling.contaminated(docs.limit(0), items).count() == 0


def test_only_what_sets_allow_to_be_linked_stays_under_a_key(spark):
    """Alike in the first word of the ring, of other roots: a row stays only with one that sizes and parities allow, and with all of these."""
    import pyarrow as pa

    from siftrock.llm import set_join

    rng, rows = np.random.default_rng(4), []
    for key in range(40):
        base = rng.integers(0, 2**63, 100, np.uint64)
        for node in range(6):
            some = base.copy()
            k = int(rng.integers(0, 80))
            some[:k] = rng.integers(0, 2**63, k, np.uint64)
            rows.append((key, node, 0, node, np.unique(some)))
    bits = [set_join.parities(set_join.mix(r[4]), simhash.PARITIES) for r in rows]
    g = simhash.folded(np.frombuffer(b"".join(bits), np.uint64).reshape(len(rows), -1)).view(np.int64)
    cols = [pa.array([r[i] for r in rows], pa.int64()) for i in range(4)] + [pa.array([len(r[4]) for r in rows], pa.int32())] + [pa.array(g[:, k].copy()) for k in range(2)]
    got = pa.Table.from_batches(simhash._partners(23, 64, 80)(pa.RecordBatch.from_arrays(cols, simhash.FOLDED).slice(a, 50) for a in range(0, len(rows), 50)))
    got = set(zip(got.column("key").to_pylist(), got.column("node").to_pylist()))
    linked = {r[:2] for r in rows for s in rows if r[0] == s[0] and r[1] != s[1] and 100 * len(np.intersect1d(r[4], s[4])) >= 80 * len(np.union1d(r[4], s[4]))}
    assert linked <= got and len(linked) <= len(got) < 0.9 * len(rows)
