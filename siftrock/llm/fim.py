"""Fill-in-the-middle: documents cut at two characters and put in another order, so that a model learns to fill gaps.

The cuts are drawn in characters (code points), but texts are UTF-8. A batch's texts lie in one Arrow buffer, and a packed bitvector
over its bytes has a one where a character begins. A directory holds the ones before each block of 512 bits. A text's
length in characters is the ones within it (two ranks); a cut at a character is a select, which searches the directory
for the block and counts on within eight words. Nothing is decoded and no character is looked at alone.

Defined results: a null text is an empty one; an empty text, and one that holds a mark, stays plain. A null id is drawn for as an empty string;
repeated rows are cut alike. An empty table gives an empty one. Columns of ``docs`` are kept but for those named as a result.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .shared import free_name, sliced

MARKS = ("<P>", "<S>", "<M>")
RESULT = ("n", "form", "prefix_chars", "middle_chars", "output")
WORD, BLOCK = 64, 8  # bits of a word, words of a block


class Bits:
    """A packed bitvector with rank and select over arrays of places."""

    def __init__(self, ones: np.ndarray):
        """``ones``: a boolean for each bit."""
        words = -(-len(ones) // (WORD * BLOCK)) * BLOCK + BLOCK  # an empty block behind the last one, so that every place has one
        packed = np.zeros(words * 8, np.uint8)
        some = np.packbits(ones, bitorder="little")
        packed[: len(some)] = some
        self.words = packed.view("<u8")
        counts = np.bitwise_count(self.words).reshape(-1, BLOCK)
        self.within = np.zeros(counts.shape, np.uint16)  # the ones of the block before each of its words
        np.cumsum(counts[:, :-1], axis=1, out=self.within[:, 1:])
        self.before = np.concatenate([[0], np.cumsum(counts.sum(1, dtype=np.int64))])  # the directory

    def rank(self, at: np.ndarray) -> np.ndarray:
        """The ones before each place."""
        word, bit = np.divmod(np.asarray(at, np.int64), WORD)
        low = self.words[word] & ((np.uint64(1) << bit.astype(np.uint64)) - np.uint64(1))
        return self.before[word // BLOCK] + self.within[word // BLOCK, word % BLOCK] + np.bitwise_count(low)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The place of each one of these numbers, counted from 0; there must be one."""
        k = np.asarray(k, np.int64)
        block = np.searchsorted(self.before, k, side="right") - 1
        left = k - self.before[block]
        word = (self.within[block] <= left[:, None]).sum(1) - 1  # the last word with no more ones before it
        left -= self.within[block, word]
        value, at = self.words[block * BLOCK + word], np.zeros(len(k), np.int64)
        for half in (32, 16, 8, 4, 2, 1):
            ones = np.bitwise_count(value & np.uint64((1 << half) - 1)).astype(np.int64)
            on = left >= ones
            left -= np.where(on, ones, 0)
            at += np.where(on, half, 0)
            value = np.where(on, value >> np.uint64(half), value)
        return (block * BLOCK + word) * WORD + at


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of strings without nulls, and where each begins and the last ends."""
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8))[ends[0] : ends[-1]], ends - ends[0]


def cut(texts: pa.Array, first: np.ndarray, second: np.ndarray, form: Sequence[str], marks: Sequence[str] = MARKS):
    """(characters, smaller cut, larger cut, outputs) of texts; the draws are reduced modulo characters + 1."""
    data, ends = _bytes(texts)
    bits = Bits((data & 0xC0) != 0x80)
    ones = bits.rank(ends)
    n = np.diff(ones)
    cuts = np.sort(np.stack([first % (n + 1), second % (n + 1)]), axis=0)
    at = ones[:-1] + cuts  # the number of the character that each cut stands before
    last = at == ones[1:]
    places = np.where(last, ends[1:], 0)
    places[~last] = bits.select(at[~last])
    prefix, suffix, middle = (m.encode() for m in marks)
    raw, out = data.tobytes(), []
    for f, start, a, b, end in zip(form, ends[:-1].tolist(), *places.tolist(), ends[1:].tolist(), strict=True):
        if f == "plain":
            out.append(raw[start:end])
        elif f == "psm":
            out.append(b"".join((prefix, raw[start:a], suffix, raw[b:end], middle, raw[a:b])))
        else:
            out.append(b"".join((suffix, raw[b:end], prefix, raw[start:a], middle, raw[a:b])))
    return n, *cuts, pa.array(out, pa.large_binary()).cast(pa.large_string())


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit draws of a document: the groups of the hash of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def check_marks(marks: Sequence[str]) -> None:
    """Where no mark's end is another's beginning, the first of each in an output is the one that was put there."""
    if len(marks) != 3 or len(set(marks)) != 3 or not all(marks):
        raise ValueError("three different marks are needed")
    if any(a in b for a in marks for b in marks if a != b) or any(a[-i:] == b[:i] for a in marks for b in marks for i in range(1, min(len(a), len(b)))):
        raise ValueError("marks must not overlap each other or themselves")


def fill_in_middle(docs: DataFrame, *, percent: int = 90, spm_percent: int = 20, seed: int = 1, marks: Sequence[str] = MARKS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with n (characters), form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and output.

    ``percent`` of the texts that may be cut are, ``spm_percent`` of these with the suffix first. What a document becomes depends on its
    id, its text and ``seed`` alone. One pass, nothing is shuffled.
    """
    check_marks(marks)
    value = F.coalesce(F.col(text), F.lit(""))
    h = draws(F.col(doc_id), seed)
    plain = (value == "") | (h[2] % 100 >= percent)
    for m in marks:
        plain = plain | F.contains(value, F.lit(m))
    form = F.when(plain, "plain").when(h[3] % 100 < spm_percent, "spm").otherwise("psm")
    kept = [c for c in docs.columns if c.lower() not in RESULT]
    whole, first, second, kind = (free_name(docs, c) for c in ("whole", "first", "second", "kind"))
    rows = docs.select(*kept, value.alias(whole), h[0].alias(first), h[1].alias(second), form.alias(kind))
    nullable = [StructField(c, t, True) for c, t in zip(RESULT, (LongType(), StringType(), LongType(), LongType(), StringType()))]
    schema = StructType([*docs.select(*kept).schema.fields, *nullable])
    names = [f.name for f in schema.fields]

    def run(batches):
        for batch in sliced(batches):
            forms = batch.column(len(kept) + 3)
            cutting = np.array([f != "plain" for f in forms.to_pylist()], bool)
            one, two = (batch.column(len(kept) + i).to_numpy() for i in (1, 2))
            n, a, b, out = cut(batch.column(len(kept)), one, two, forms.to_pylist(), marks)
            chars = [pa.array(x, pa.int64(), mask=~cutting) for x in (a, b - a)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(n, pa.int64()), forms, *chars, out.cast(forms.type)], names)

    return rows.mapInArrow(run, schema)


def restored(output: Column, form: Column, marks: Sequence[str] = MARKS) -> Column:
    """The text that an output was made of."""
    prefix, suffix, middle = marks

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        rest = F.substring(output, F.lit(len(first) + 1), F.length(output))
        tail = F.split_part(rest, F.lit(second), F.lit(2))
        return F.split_part(rest, F.lit(second), F.lit(1)), F.split_part(tail, F.lit(middle), F.lit(1)), F.split_part(tail, F.lit(middle), F.lit(2))

    p, s, m = parts(prefix, suffix)
    s2, p2, m2 = parts(suffix, prefix)
    return F.when(form == "psm", F.concat(p, m, s)).when(form == "spm", F.concat(p2, m2, s2)).otherwise(output)


def op12(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    cuts = fill_in_middle(docs)
    digest = lambda c: F.sha2(c, 256)
    return cuts.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


ORACLE = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS hex FROM documents),
h AS (
  SELECT *, ('0x' || substr(hex, 1, 8))::BIGINT AS h1, ('0x' || substr(hex, 9, 8))::BIGINT AS h2,
    ('0x' || substr(hex, 17, 8))::BIGINT AS h3, ('0x' || substr(hex, 25, 8))::BIGINT AS h4 FROM d),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substring(text, 1, a) AS prefix, substring(text, a + 1, b - a) AS middle, substring(text, b + 1, n - b) AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form != 'plain' THEN a END AS prefix_chars, CASE WHEN form != 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""
