"""The pipeline's stages on the driver's smallest tables: what each may and may not do, and on empty and odd rows."""

import corpus_pipeline
import public_tokenizers

from siftrock.llm import tiling
from test_models_and_search import plain_base

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        seen[name] = {r.doc_id: r for r in docs.collect()}
    first = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    ids = [set(x) for x in seen.values()]
    assert all(b <= a for a, b in zip(ids, ids[1:])) and ids[3] == ids[4] == ids[2]
    texts = [r.text for r in seen["near_duplicates"].values()]
    assert len(set(texts)) == len(texts)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    index = tiling.Index(items, 4)
    for i, r in seen["near_duplicates"].items():
        assert (i in seen["decontamination"]) == (not tiling.held_items(index, r.text, 0.5))
    for i, r in seen["personal_data"].items():
        assert r.n_chars == len(r.text)
        assert not plain_base(r.text)
        if not plain_base(first[i]) and r.text != first[i]:
            assert "[" in r.text
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, r in seen["personal_data"].items():
        assert seen["packing"][i].doc_tokens == len(t.encode(r.text, add_special_tokens=False).ids) + 1


def test_stages_of_nothing_and_of_odd_rows(spark):
    schema = spark.read.parquet(f"{DATA}/documents.parquet").schema
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "x" * 100_000, None, None, 100_000)]
    for data in ([], rows):
        docs = spark.createDataFrame(data, schema)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, DATA)
            if name != "packing":
                assert out.columns == docs.columns
            out.collect()


def test_run_against_plain_versions(spark):
    """Whole run: the documents that come out are those left by quality, one of each group that all pairs of sets link, without benchmark items; every id is packed once."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    good = {r.doc_id: r.text for r in corpus_pipeline.good_quality(spark, docs, DATA).collect()}
    sets = {}
    for i, t in good.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {}
    for i in sorted(sets):
        if i not in root:
            todo, root[i] = [i], i
            while todo:
                a = todo.pop()
                for b in sets:
                    if b not in root and (sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) > 0):
                        root[b] = i
                        todo.append(b)
    index = tiling.Index([(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()], 4)
    want = {i for i in set(root.values()) if not tiling.held_items(index, good[i], 0.5)}
    pieces = corpus_pipeline.run(spark, DATA).collect()
    assert {r.doc_id for r in pieces} == want
    held = {}
    for r in pieces:
        held.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
    for some in held.values():
        at = 0
        for start, length, total in sorted(some):
            assert start == at
            at += length
        assert at == some[0][2]
