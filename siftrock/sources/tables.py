"""The tables of a data folder, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def document_files(spark: SparkSession, folder: str) -> DataFrame:
    """``documents`` as files: path, content, source (folder) and lang."""
    return table(spark, folder, "documents").select(F.col("doc_id").alias("path"), F.col("text").alias("content"), "source", "lang")
