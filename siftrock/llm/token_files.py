"""Token-id files: flat unsigned integers, 64-bit document offsets, memory-mapped reading.

Documents are range-partitioned by id and sorted, and every partition writes three files into one
folder: ``.bin`` (ids, little-endian, 16 or 32 bits wide as the vocabulary needs), ``.idx``
(documents + 1 offsets in ids, little-endian signed 64-bit, counted from the partition's start) and ``.doc``
(the documents' ids, Arrow). The manifest has a row per partition; a partition's base, the ids before
it, is the prefix sum of the counts before it. Names are unique to a task's attempt and only files
that the manifest names count, so retries and lost executors leave nothing behind that is read.

Defined results: a null text is an empty one and gives the end id alone. Null ids come first. Repeated ids
stay separate documents, in the order of a hash of their texts. An empty table writes no file.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import file_system, fresh_path, open_input, sliced, written
from .tokens import encoder

MANIFEST = "part int, path string, width int, n_docs long, n_tokens long"
ROWS = 4096


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, *, spaces: str = "whole", end_id: int, doc_id: str = "doc_id", text: str = "text", partitions: int | None = None) -> DataFrame:
    """Write the files of ``docs`` into ``folder``; returns the manifest, with each partition's ``base``."""
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    order = ["doc_id", F.xxhash64("text"), "text"]  # the hash, so that an id that many rows repeat, or none, is no single range
    ordered = rows.repartitionByRange(n, *order[:2]).sortWithinPartitions(*order)

    def write(batches):
        from pyspark import TaskContext

        enc = encoder(tokenizer, spaces)
        part = TaskContext.get().partitionId()
        path = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}"
        end = np.array([end_id], enc.dtype).tobytes()
        store, place = file_system(path)
        store.create_dir(place.rpartition("/")[0], recursive=True)
        lengths, ids = [], []
        with store.open_output_stream(place + ".bin") as out:
            for some in sliced(batches):
                data = enc.encode(some.column("text").to_pylist())
                lengths += [len(d) // enc.dtype.itemsize + 1 for d in data]
                ids.append(some.column("doc_id"))
                out.write(b"".join(x for d in data for x in (d, end)))
        if not lengths:
            store.delete_file(place + ".bin")
            return
        offsets = np.concatenate([[0], np.cumsum(np.array(lengths, np.int64))]).astype("<i8")
        with store.open_output_stream(place + ".idx") as out:
            out.write(offsets.tobytes())
        table = pa.table({"doc_id": pa.chunked_array(ids)})
        with store.open_output_stream(place + ".doc") as out, pa.ipc.new_file(out, table.schema) as to:
            to.write_table(table)
        yield pa.RecordBatch.from_pydict(
            {"part": [part], "path": [path], "width": [enc.dtype.itemsize], "n_docs": [len(lengths)], "n_tokens": [int(offsets[-1])]},
            pa.schema([("part", pa.int32()), ("path", pa.string()), ("width", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]),
        )

    manifest = written(ordered.mapInArrow(write, MANIFEST), "token-manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition, not per document
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_tokens(manifest: DataFrame, *, with_ids: bool = False, partitions: int | None = None) -> DataFrame:
    """A row per document from the files: doc_id, start, n_tokens, ids_crc32 and, if asked, ids (array<long>)."""
    n = partitions or int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                with open_input(row["path"] + ".idx") as f:
                    offsets = np.frombuffer(f.read_buffer(), "<i8")
                with open_input(row["path"] + ".doc") as f:
                    ids = pa.ipc.open_file(f).read_all().column("doc_id").combine_chunks().cast(pa.int64())
                with open_input(row["path"] + ".bin") as f:
                    for at in range(0, row["n_docs"], ROWS):
                        here = offsets[at : at + ROWS + 1]
                        f.seek(int(here[0]) * row["width"])
                        flat = np.frombuffer(f.read_buffer(int(here[-1] - here[0]) * row["width"]), f"<u{row['width']}")
                        cuts = (here - here[0]).tolist()
                        parts = [flat[a:b].astype("<u4") for a, b in zip(cuts, cuts[1:], strict=False)]
                        cols = {
                            "doc_id": ids.slice(at, len(parts)),
                            "start": pa.array(here[:-1] + row["base"]),
                            "n_tokens": pa.array(np.diff(here)),
                            "ids_crc32": pa.array([zlib.crc32(p) for p in parts], pa.int64()),
                        }
                        if with_ids:
                            cols["ids"] = pa.array([p.astype(np.int64) for p in parts], pa.list_(pa.int64()))
                        yield pa.RecordBatch.from_pydict(cols)

    return manifest.select("part", "path", "width", "n_docs", "base").repartitionByRange(n, "part").mapInArrow(read, schema)


def op4(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    manifest = write_tokens(docs, fresh_path(spark, "tokens"), public_tokenizers.path("word_bpe_49k.json"), spaces="dropped", end_id=2)
    return read_tokens(manifest)
