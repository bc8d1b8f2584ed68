"""What is done with findings: deduplicate, number, count, judge, summarise. Aggregates are partial before each shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANKS = ("CRITICAL", "MAJOR", "MINOR", "NIT")


def keep_first(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """A row of each key, the first by ``order``; a minimum of structs, so that no key's rows are gathered."""
    rest = [c for c in rows.columns if c not in keys and c not in order]
    first = F.min(F.struct(*order, *rest)).alias("_first")
    return rows.groupBy(*keys).agg(first).select(*keys, *[F.col(f"_first.{c}").alias(c) for c in (*order, *rest)]).select(*rows.columns)


def by_category(findings: DataFrame) -> DataFrame:
    return findings.groupBy("category", "code").agg(F.count(F.lit(1)).alias("n"))


def counts(rows: DataFrame, *sets: str) -> DataFrame:
    """Counts for each of several columns in one pass: (dimension, value, n)."""
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("dimension"), F.col(s).cast("string").alias("value")) for s in sets]))
    return rows.select(each.alias("x")).groupBy("x.dimension", "x.value").agg(F.count(F.lit(1)).alias("n"))


def at_least(rows: DataFrame, severity: str, column: str = "severity") -> DataFrame:
    return rows.where(F.col(column).isin(*RANKS[: RANKS.index(severity) + 1]))


def severity_counts() -> list[Column]:
    return [F.count(F.when(F.col("severity") == r, 1)).alias(r.lower()) for r in RANKS]


def per_file(rows: DataFrame, file: str = "file") -> DataFrame:
    """A row per file with the number of its findings of each severity."""
    return rows.groupBy(file).agg(*severity_counts())


def gate(rows: DataFrame, group: str) -> DataFrame:
    """PASS if there is nothing critical or major and nothing unverified (severity null and not verified)."""
    out = rows.groupBy(group).agg(*severity_counts(), F.count(F.when(~F.col("verified"), 1)).alias("unverified"))
    return out.withColumn("verdict", F.when((F.col("critical") + F.col("major") + F.col("unverified")) == 0, "PASS").otherwise("FAIL"))


def review_verdict(rows: DataFrame, group: str) -> DataFrame:
    out = rows.groupBy(group).agg(*severity_counts())
    out = out.select(group, (F.col("critical") + F.col("major")).alias("must_fix"), F.col("minor").alias("should_fix"), "nit")
    return out.withColumn("verdict", F.when(F.col("must_fix") > 0, "FAIL").when(F.col("should_fix") > 0, "CONDITIONAL").otherwise("PASS"))


def audit_summary(rows: DataFrame, file: str = "file") -> DataFrame:
    """One row, one sentence. Files are counted from a first aggregate by file."""
    total = per_file(rows, file).agg(*[F.sum(r.lower()).alias(r.lower()) for r in RANKS], F.count(F.lit(1)).alias("files"))
    return total.select(F.format_string("%d CRITICAL, %d MAJOR, %d MINOR, %d NIT across %d files", *[r.lower() for r in RANKS], "files").alias("summary"))


def confidence(evidence: Column) -> Column:
    return F.round(F.least(F.lit(0.98), F.lit(0.85) + F.lit(0.04) * evidence), 3)


def sequential_ids(rows: DataFrame, group: Sequence[str], order: Sequence[str], pattern: str = "SCEN-%04d", name: str = "id") -> DataFrame:
    """Numbers from 1 in the order of (group, order), without bringing all rows together: a number is
    the count of the rows of lower groups, by prefix sums over the groups, and the place in its own."""
    sizes = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy(*group).rowsBetween(Window.unboundedPreceding, -1)  # a row per group
    based = sizes.select(*group, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return rows.join(based, list(group)).withColumn(name, F.format_string(pattern, F.col("_base") + place)).drop("_base")


def calibrated(safety: float, most: int, **limits: tuple[Column, Column]) -> list[Column]:
    """(concurrency, binding): the least of the limits' quotients times ``safety``, whole, from 1 to ``most``, and what set it."""
    ratios = {name: have.cast("double") / need for name, (have, need) in limits.items()}
    least = F.least(*ratios.values()) if len(ratios) > 1 else next(iter(ratios.values()))
    raw = F.floor(F.lit(safety) * least)
    binding = F.when(raw >= most, "concurrency")
    for name, ratio in ratios.items():
        binding = binding.when(ratio == least, name)
    return [F.greatest(F.lit(1), F.least(F.lit(most), raw)).cast("int").alias("concurrency"), binding.alias("binding")]
