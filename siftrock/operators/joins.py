"""Joins between what is referenced and what is declared, gates, globs, expansion and nearest-before lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftrock.functions.text import glob_regex


def undeclared(references: DataFrame, declared: DataFrame, key: str, site: Sequence[str]) -> DataFrame:
    """Referenced names that nothing declares: (key, first site, number of sites). A hot name is one partial aggregate per task."""
    sites = references.groupBy(key).agg(F.min(F.struct(*site)).alias("_s"), F.count(F.lit(1)).alias("sites"))
    return sites.join(declared.select(key).distinct(), key, "left_anti").select(key, *[F.col(f"_s.{c}").alias(c) for c in site], "sites")


def unused(declared: DataFrame, references: DataFrame, key: str) -> DataFrame:
    return declared.select(key).distinct().join(references.select(key).distinct(), key, "left_anti")


def drift(left: Column, right: Column) -> tuple[Column, Column]:
    """What only one of two arrays has, sorted: (missing on the right, missing on the left)."""
    return F.array_sort(F.array_except(left, right)), F.array_sort(F.array_except(right, left))


def with_globs(files: DataFrame, globs: dict[str, Sequence[str]], path: str, out: str = "lens") -> DataFrame:
    """A row for each file and name one of whose globs fits. Globs are a bounded parameter and become one expression, so
    that no theta join is planned."""
    fits = [F.when(F.col(path).rlike("|".join(f"(?:{glob_regex(g)})" for g in some)), name) for name, some in globs.items()]
    return files.withColumn(out, F.explode(F.array_compact(F.array(*fits))))


def gated(tools: DataFrame, gates: DataFrame, detected: DataFrame, tool: str, need: str) -> DataFrame:
    """``tools`` with ``fires``: whether any of a tool's needs is detected."""
    met = gates.join(detected.select(need).distinct(), need, "left_semi").select(tool).distinct().withColumn("_met", F.lit(True))
    return tools.join(met, tool, "left").withColumn("fires", F.coalesce("_met", F.lit(False))).drop("_met")


def expanded(points: DataFrame, families: DataFrame, key: str) -> DataFrame:
    """Every entry point with every family of its type, once each."""
    return points.join(families.dropDuplicates(), key).dropDuplicates()


def nearest_before(rows: DataFrame, keys: Sequence[str], order: Sequence[str], marked: Column, value: Column, out: str) -> DataFrame:
    """``rows`` with the value of the last marked row up to each, within its keys."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(out, F.last(F.when(marked, value), ignorenulls=True).over(w))
