"""The rules on a stream of files. They are stateless, so they run as they are and need no watermark; a query's
checkpoint goes to the folder that the caller names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftrock.operators import rules


def hardcoded_stream(files: DataFrame) -> DataFrame:
    return rules.hardcoded(files)


def windowed_counts(events: DataFrame, time: str, key: str, *, width: str, late: str) -> DataFrame:
    """Counts by key in tumbling windows; rows later than ``late`` are dropped by the watermark, as Spark defines it."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")
