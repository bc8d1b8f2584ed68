"""Parts of a set of files: those that a list names, what a whole scan looks at, and the keys that a gate's document must have."""

from __future__ import annotations

import posixpath
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _inside(paths: pd.Series) -> pd.Series:
    def one(path):
        path = posixpath.normpath(path)
        return None if path.startswith(("/", "../")) or path in (".", "..") else path

    return paths.map(one, na_action="ignore")


def inside(path: Column) -> Column:
    """A relative path without detours, or null if it leads out of the tree."""
    return F.pandas_udf(_inside, StringType())(path)


def listed(lines: DataFrame, line: str = "value") -> DataFrame:
    """(path) of a list's lines, once each: blank ones, those that begin with ``#`` and paths that lead out of the tree are left out."""
    named = F.regexp_replace(F.col(line), r"^\s+|\s+$", "")
    rows = lines.select(named.alias("path")).where("path != ''").where(~F.col("path").startswith("#")).distinct()
    return rows.select(inside(F.col("path")).alias("path")).where("path IS NOT NULL").distinct()


def subset(files: DataFrame, lines: DataFrame, line: str = "value") -> DataFrame:
    """Those of ``files`` that a list names. Names of no file are ignored."""
    return files.join(listed(lines, line), "path", "left_semi")


#: Folders and suffixes that a scan of everything leaves out: documents, other people's code, samples, reports, what is built, binaries.
LEFT_OUT = ("docs", "doc", "vendor", "third_party", "node_modules", "fixtures", "testdata", "reports", "dist", "build", "target", "out")
BINARY = (".png", ".jpg", ".jpeg", ".gif", ".ico", ".pdf", ".zip", ".gz", ".tar", ".jar", ".so", ".dll", ".dylib", ".exe", ".bin", ".woff", ".woff2", ".ttf", ".mp4", ".mp3")


def whole(files: DataFrame, folders: Sequence[str] = LEFT_OUT, suffixes: Sequence[str] = BINARY) -> DataFrame:
    """What a scan of everything looks at. A predicate on paths alone, so that it can go down to the source."""
    parts, path = F.split("path", "/"), F.lower("path")
    above = F.slice(parts, 1, F.size(parts) - 1)
    suffix = F.concat(F.lit("."), F.substring_index(F.substring_index(path, "/", -1), ".", -1))
    return files.where(~F.arrays_overlap(above, F.array(*map(F.lit, folders))) & ~suffix.isin(*suffixes))


def gate(spark, path: str, key: str, schema: str) -> DataFrame:
    """The rows of one JSON document read by ``schema`` (of its ``key``); an error if it isn't one object that has this key."""
    rows = spark.read.json(path, schema=f"{key} {schema}, _corrupt string", multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt")
    bad = F.raise_error(F.lit(f"{path} is no document with the key {key!r}"))
    return rows.select(F.when(F.col("_corrupt").isNull() & F.col(key).isNotNull(), F.col(key)).otherwise(bad).alias(key))
