"""What functions over Arrow batches need: rows dealt over tasks, and found rows gathered into batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed value: rows of a batch that goes out, about.
ROWS = 4096


def spread(rows: DataFrame) -> DataFrame:
    """Short rows that are the beginning of long work, dealt over all tasks of a shuffle, however few parts their file has."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def gathered(rows: Iterable[tuple], types: Sequence[pa.DataType], names: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """Batches of ``ROWS`` rows; a batch for each file would cost more than what is found in it."""
    held = []

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], list(names))

    for row in rows:
        held.append(row)
        if len(held) >= ROWS:
            yield batch()
            held = []
    if held:
        yield batch()


def texts(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[tuple]:
    """(path, content) of each row; a slice's texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            some = batch.slice(at, rows)
            yield from zip(some.column("path").to_pylist(), some.column("content").to_pylist(), strict=True)
