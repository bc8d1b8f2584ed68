"""Token files, archives and packing: round trips and invariants, against the tokenizers library used plainly."""

import base64
import functools
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from siftrock.llm import packing, token_files, warc
from siftrock.llm.shared import fresh_path

random.seed(9)
PIECES = ["the", "Hello,", "world!", "don't", "x1y2", "naïve", "Straße", "日本語", "\n", "\n\n", "  ", "\t", "...", "A-b", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext|", "’s", "İ", "3.14", "ﬁ", "\r\n", " ", "é"]
TEXTS = [None, "", " ", "\n", "a", " a", "a ", "line\nline\n"] + ["".join(random.choice(PIECES) + random.choice(["", " ", " ", "\n"]) for _ in range(random.randint(1, 60))) for _ in range(60)] + ["word " * 5000]


@functools.cache
def tokenizer(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


def plain_ids(name, text):
    return tokenizer(name).encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(3 * i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string").repartition(3)


def test_token_files_round_trip(spark, docs):
    manifest = token_files.write_tokens(docs, fresh_path(spark, "t"), public_tokenizers.path("word_bpe_49k.json"), spaces="dropped", end_id=2)
    got = {r.doc_id: r for r in token_files.read_tokens(manifest, with_ids=True).collect()}
    start = 0
    for i, t in enumerate(TEXTS):
        want = plain_ids("word_bpe_49k.json", t) + [2]
        r = got[3 * i]
        assert (r.ids, r.start, r.n_tokens, r.ids_crc32) == (want, start, len(want), crc(want)), repr(t)[:80]
        start += len(want)
    assert len(got) == len(TEXTS)


def test_token_files_of_nothing(spark, docs):
    manifest = token_files.write_tokens(docs.limit(0), fresh_path(spark, "t"), public_tokenizers.path("word_bpe_49k.json"), spaces="dropped", end_id=2)
    assert token_files.read_tokens(manifest).collect() == []


def test_packing_places_every_id_once(spark, docs):
    rows = packing.pack_documents(docs).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    total = 0
    for i, t in enumerate(TEXTS):
        want, at = plain_ids("byte_bpe_50k.json", t) + [0], 0
        for r in sorted(by_doc[3 * i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(want), crc(want[at : at + r.length])), repr(t)[:80]
            at += r.length
        assert at == len(want)
        total += at
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.SIZE
    assert len(by_sequence) <= -(-total // packing.SIZE) * 1.05 + 2
    assert packing.pack_documents(docs.limit(0)).collect() == []


def planned(demand):
    """The number of sequences; every length is held as often as it is asked for and no sequence is too long."""
    patterns, held = packing.plan(demand), {}
    for p, n in patterns:
        assert sum(k * c for k, c in p.items()) <= packing.SIZE
        for k, c in p.items():
            held[k] = held.get(k, 0) + c * n
    assert held == demand
    return sum(n for _, n in patterns)


def test_specials_in_texts_are_those_of_a_plain_call(spark):
    text = "a <|endoftext|> b<|startoftext|>c <|EndOfText|>"
    for name, spaces in (("word_bpe_49k.json", "dropped"), ("byte_bpe_50k.json", "leading")):
        from siftrock.llm.tokens import PieceEncoder

        e = PieceEncoder(public_tokenizers.path(name), spaces)
        assert np.frombuffer(e.encode([text])[0], e.dtype).tolist() == plain_ids(name, text)


@pytest.mark.parametrize("keep_bytes", [0, 2_000, 10**8])
def test_what_a_worker_keeps_is_bounded_and_changes_no_ids(keep_bytes):
    from siftrock.llm.tokens import ENTRY_BYTES, PieceEncoder

    for name, spaces in (("word_bpe_49k.json", "dropped"), ("byte_bpe_50k.json", "leading")):
        e = PieceEncoder(public_tokenizers.path(name), spaces, keep_bytes)
        for _ in range(2):
            for t in TEXTS:
                assert np.frombuffer(e.encode([t or ""])[0], e.dtype).tolist() == plain_ids(name, t), repr(t)[:80]
        assert e.known.held <= keep_bytes + ENTRY_BYTES


LENGTHS = {
    "all": lambda r: r.integers(1, 1024, 200_000),
    "few of each": lambda r: np.repeat(np.arange(1, 1001), 4),
    "long": lambda r: r.integers(400, 1024, 50_000),
    "middle": lambda r: r.integers(250, 520, 50_000),
    "one document each": lambda r: r.integers(1, 1024, 2_000),
}


@pytest.mark.parametrize("kind", sorted(LENGTHS))
def test_column_generation_reaches_the_bound(kind):
    lengths = LENGTHS[kind](np.random.default_rng(2))
    demand = {int(k): int(v) for k, v in zip(*np.unique(lengths, return_counts=True))}
    patterns, bound = packing.column_generation(demand)
    assert bound >= sum(k * v for k, v in demand.items()) / packing.SIZE - 1e-6
    covered = {}
    for p, uses in patterns:
        for k, c in p.items():
            covered[k] = covered.get(k, 0) + c * uses
    assert all(abs(covered[k] - v) < 1e-3 * max(1, v) for k, v in demand.items())
    assert planned(demand) <= 1.02 * bound + 1


def test_a_plan_of_any_lengths_is_whole():
    assert planned({}) == 0
    assert planned({1023: 3, 1: 3}) == 3
    assert planned({600: 5}) == 5
    planned({int(k): 1 for k in range(1, 200)})


def test_archives_round_trip(spark):
    htmls = [None, "", "", "<p>é</p>", "<p>é</p>", "<p>é</p>", "x" * 70_000] + [f"<html><body>page {i} {'common text ' * 20}</body></html>" for i in range(40)]
    pages = [(i, None if i == 4 else f"http://h{i}.org/\r\nX: y", h) for i, h in enumerate(htmls)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    manifest = warc.write_archives(df, fresh_path(spark, "w"))
    got = {r.page_id: r for r in warc.read_archives(manifest, with_payload=True).collect()}
    last = {}
    for i, _, h in pages:
        last[h or ""] = i
    for i, _, h in pages:
        body = (h or "").encode()
        keeper = last[h or ""]
        kind = "response" if keeper == i else "revisit"
        r = got[i]
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), kind, None if kind == "response" else keeper)
        assert bytes(r.payload) == (body if kind == "response" else b"")
    with open(manifest.first().path.removeprefix("file://"), "rb") as f:
        data = memoryview(f.read())
    dictionary, cuts = warc.frames(data)
    assert dictionary and cuts[-1][1] == len(data)
    assert warc.read_archives(warc.write_archives(df.limit(0), fresh_path(spark, "w"))).collect() == []


def test_archives_repeat_rows_and_lack_ids(spark):
    df = spark.createDataFrame([(None, "u", "a"), (None, "u", "a"), (5, "u", "b"), (5, "u", "b"), (1, "u", "b")], "page_id long, url string, html string")
    got = warc.read_archives(warc.write_archives(df, fresh_path(spark, "w"))).collect()
    assert sorted(((r.page_id or 0), r.record_type, r.refers_to or 0) for r in got) == [(0, "response", 0), (0, "response", 0), (1, "revisit", 5), (5, "response", 0), (5, "response", 0)]
