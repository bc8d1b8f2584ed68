"""What several operators need: the shared folder, written intermediate tables, files in that folder, slices of Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftrock.sinks.shared import fresh_path, shared_dir, written  # noqa: F401  (for the operators)


def file_system(uri: str):
    """(file system, path) for a URI, usable in tasks on any store that pyarrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def open_input(uri: str):
    """A random-access reader of ``uri``: memory-mapped where the store is a mounted file system."""
    import pyarrow as pa
    from pyarrow import fs

    store, path = file_system(uri)
    return pa.memory_map(path, "r") if isinstance(store, fs.LocalFileSystem) else store.open_input_file(path)


def held_out(doc_id: str = "doc_id"):
    """True for documents no model may learn from: crc32 of the id as text, modulo 4, is 2. Null ids: false."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def hash_cut(rows: int, total: int) -> int | None:
    """The 64-bit hash below which twice ``rows`` of ``total`` evenly hashed rows lie, and some more; None: all of them.

    A filter for the smallest hashes before they are sorted, so that the last task gets a few times ``rows`` and not that many from each partition.
    """
    share = (2 * rows + 200) / max(1, total)
    return None if share >= 1 else int(-(2**63) + 2**64 * share)


def sliced(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """``batches`` in slices of at most ``rows``, so that only a slice's texts are Python objects at a time. When the task ends, what its
    worker no longer uses goes back to the system: workers outlive tasks, and several share an executor's memory."""
    try:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield batch.slice(at, rows)
            del batch
    finally:
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as keep it apart from the columns of ``df`` (their case doesn't count)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
