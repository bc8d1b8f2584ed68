"""WARC archives with one Zstandard dictionary, and their reader.

A dictionary is built from a bounded sample of records (``sample_records``, those with the smallest hashes).
Every archive starts with it, in a skippable frame (magic 0x184D2A5D), and every record is a frame of its
own, so a record can be read alone and each file needs nothing beside it. Of the pages with equal payloads the one
with the largest page_id is stored as a response; the others are revisit records that name it and
keep the HTTP header, with the full payload's length, but no body.

Defined results: a null html is the empty payload. A page without an id is a response only where no page of
its payload has one. Rows that repeat an id stay separate records; those that repeat a response are responses too. Null urls are written as ``urn:page:<id>``. An empty table writes no archive.
Files carry the names of the attempts that wrote them, and only those in the manifest are read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import file_system, fresh_path, open_input, written

MAGIC = 0x184D2A5D
FRAME = 0xFD2FB528
MANIFEST = "path string, n_records long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
DATE = "2000-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, sha1: str, size: int, refers_to: int | None, revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = " ".join(url.split()) if url and url.strip() else f"urn:page:{page_id}"
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{url}')}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{sha1}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if revisit:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        if refers_to is not None:
            head.append(f"X-Refers-To-Page-ID: {refers_to}")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes, int]:
    """(headers by lower-case name, body, the HTTP header's content length)."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8").split("\r\n")[1:])
    fields = {k.lower(): v for k, v in fields.items()}
    block = rest[: int(fields["content-length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    size = int(http.rpartition(b"Content-Length: ")[2])
    return fields, body, size


def build_dictionary(pages: DataFrame, *, sample_records: int = 400, sample_bytes: int = 16_384, dictionary_bytes: int = 65_536) -> bytes:
    """A dictionary from at most ``sample_records`` records, at most ``sample_bytes`` of each; empty if they are too few."""
    import zstandard

    some = pages.where("length(html) > 0").select("page_id", "url", F.substring("html", 1, sample_bytes).alias("html"), F.xxhash64("page_id", "url").alias("_h"))
    # hashes alone first: else every task would send sample_records texts to the driver
    lowest = [r[0] for r in some.select("_h").orderBy("_h").limit(sample_records).collect()]
    some = some.where(F.col("_h") <= lowest[-1]).orderBy("_h", "page_id").limit(sample_records).collect() if lowest else []
    records = [record_bytes(r.page_id, r.url, h := r.html.encode("utf-8", "replace"), digest(h), len(h), None, False) for r in some]
    if len(records) < 8:
        return b""
    try:
        return zstandard.train_dictionary(min(dictionary_bytes, sum(map(len, records)) // 8), records, level=6).as_bytes()
    except zstandard.ZstdError:
        return b""


def _compressor(dictionary: bytes):
    import zstandard

    extra = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
    return zstandard.ZstdCompressor(level=6, write_checksum=True, write_content_size=True, **extra)


def write_archives(pages: DataFrame, folder: str, *, dictionary: bytes | None = None, **sampling) -> DataFrame:
    """Write ``pages`` into archives, one per task; returns the manifest."""
    spark = pages.sparkSession
    if dictionary is None:
        dictionary = build_dictionary(pages, **sampling)
    shared = spark.sparkContext.broadcast(dictionary)  # at most dictionary_bytes

    def write(batches):
        from pyspark import TaskContext

        zip_ = _compressor(shared.value)
        path = f"{folder}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.zst"
        store, place = file_system(path)
        store.create_dir(place.rpartition("/")[0], recursive=True)
        n, out = 0, None
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    out = store.open_output_stream(place, compression=None)
                    out.write(struct.pack("<II", MAGIC, len(shared.value)) + shared.value)
                payload = row["html"].encode("utf-8", "surrogatepass")
                out.write(zip_.compress(record_bytes(row["page_id"], row["url"], payload, digest(payload), len(payload), row["refers_to"], row["revisit"])))
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "n_records": [n]})

    return written(marked(pages).mapInArrow(write, MANIFEST), "warc-manifest")


def marked(pages: DataFrame) -> DataFrame:
    """page_id, url, html, revisit and refers_to: what each page's record is to be."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
    rows = rows.withColumn("_sha", F.sha1(F.encode("html", "utf-8")))
    # a group of copies is only counted, with partial results before the shuffle; the join back splits skewed keys
    shared = rows.groupBy("_sha").agg(F.max("page_id").alias("_last"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    revisit = F.col("_n").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_last"))
    rows = rows.join(shared, "_sha", "left").withColumn("revisit", revisit)
    return rows.select("page_id", "url", "html", "revisit", F.when(F.col("revisit"), F.col("_last")).alias("refers_to"))


def frames(data: memoryview):
    """(dictionary, [(start, end) of each record's frame]) of an archive; frames are found by their own headers."""
    import zstandard

    magic, size = struct.unpack_from("<II", data, 0)
    if magic != MAGIC:
        raise ValueError("the archive doesn't start with a dictionary frame")
    dictionary, at, cuts = bytes(data[8 : 8 + size]), 8 + size, []
    while at < len(data):
        if struct.unpack_from("<I", data, at)[0] != FRAME:
            raise ValueError("not a Zstandard frame")
        head = zstandard.get_frame_parameters(data[at : at + 18])
        end = at + zstandard.frame_header_size(data[at : at + 18])
        while True:  # blocks: a 3-byte header with a last mark, a kind and a size each
            block = int.from_bytes(data[end : end + 3], "little")
            end += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
            if block & 1:
                break
        end += 4 * head.has_checksum
        cuts.append((at, end))
        at = end
    return dictionary, cuts


def read_archives(manifest: DataFrame, *, with_payload: bool = False) -> DataFrame:
    """A row per record. Of stored payloads, length and digest are those of the bytes read, and a digest that
    isn't the record's own raises an error."""
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = RECORDS + (", url string, payload binary" if with_payload else "")
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def read(batches):
        import zstandard

        for batch in batches:
            for path in batch.column("path").to_pylist():
                with open_input(path) as f:
                    data = memoryview(f.read_buffer())
                    dictionary, cuts = frames(data)
                    extra = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
                    unzip, rows = zstandard.ZstdDecompressor(**extra), []
                    for k, (start, end) in enumerate(cuts, 1):
                        fields, body, size = parse_record(unzip.decompress(data[start:end]))
                        kind, sha1 = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
                        if kind == "response" and (len(body) != size or digest(body) != sha1):
                            raise ValueError(f"{path}: a payload differs from its digest")
                        as_int = lambda v: None if v is None else int(v)
                        row = [as_int(fields.get("x-page-id")), size, sha1, kind, as_int(fields.get("x-refers-to-page-id"))]
                        rows.append(row + [fields["warc-target-uri"], body] if with_payload else row)
                        if len(rows) == 1024 or k == len(cuts):
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=False)], names)
                            rows = []
                    del data

    return manifest.select("path").repartitionByRange(n, "path").mapInArrow(read, schema)


def op5(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return read_archives(write_archives(pages, fresh_path(spark, "warc")))


#: Base32 is spelled out: forty hexadecimal digits are 160 bits, five of them a letter.
ORACLE = """
WITH d AS (
  SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
b AS (
  SELECT *, max(page_id) OVER (PARTITION BY html) AS last,
    array_to_string(list_transform(range(1, 41), lambda i:
      substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * (strpos('0123456789abcdef', substr(hex, i::INT, 1)) - 1)::INT + 1, 4)), '') AS bits FROM d)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(5), lambda j:
    substr(bits, (5 * i + j + 1)::INT, 1)::INT * (16 >> j::INT)))::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to FROM b
"""
