"""A sink of reports: one text file each, of pieces in order, and none at all unless every task of the write has succeeded.

Rows are (report, place, text): the name of the file, the order of a piece in it, and the piece. Tasks write to names of their own; the commit, which only happens when
all tasks are done, moves the files to theirs, and an abort removes them. A retried or speculative task leaves nothing that counts.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StringType

SCHEMA = "report string, place long, text string"


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]  # where a report is, and where it belongs


class ReportWriter(DataSourceWriter):
    def __init__(self, folder: str, overwrite: bool):
        self.folder, self.overwrite, self.token = folder, overwrite, uuid.uuid4().hex

    @property
    def staging(self) -> str:
        return os.path.join(self.folder, f"_reports-{self.token}")

    def write(self, rows: Iterator) -> Written:
        """The reports of a partition, whose rows are sorted by report and place. A piece at a time is held."""
        os.makedirs(self.staging, exist_ok=True)
        done, out, name, place = [], None, None, None
        try:
            for row in rows:
                if row.report != name:
                    if out is not None:
                        out.close()
                    name, place = row.report, None
                    if any(n == name for _, n in done):
                        raise ValueError(f"the rows of report {name!r} are not together")
                    if not name or os.path.isabs(name) or ".." in name.split("/"):
                        raise ValueError(f"{name!r} is no name below the folder")
                    done.append((os.path.join(self.staging, uuid.uuid4().hex), name))
                    out = open(done[-1][0], "w", encoding="utf-8", newline="")  # noqa: SIM115
                if place is not None and row.place < place:
                    raise ValueError(f"the rows of report {name!r} are not in order")
                place = row.place
                out.write(row.text or "")
        finally:
            if out is not None:
                out.close()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        files = [f for m in messages if m is not None for f in m.files]
        names = [n for _, n in files]
        twice = {n for n in names if names.count(n) > 1} if len(set(names)) < len(names) else set()
        if twice:
            self._remove()
            raise ValueError(f"several tasks hold rows of {sorted(twice)[:3]}")
        present = [] if self.overwrite else [n for n in names if os.path.exists(os.path.join(self.folder, n))]
        if present:
            self._remove()
            raise FileExistsError(f"there is a report {present[0]!r} already")
        for at, name in files:
            to = os.path.join(self.folder, name)
            os.makedirs(os.path.dirname(to), exist_ok=True)
            os.replace(at, to)
        self._remove()

    def abort(self, messages: list[Written | None]) -> None:
        self._remove()

    def _remove(self) -> None:
        if os.path.isdir(self.staging):
            for name in os.listdir(self.staging):
                os.unlink(os.path.join(self.staging, name))
            os.rmdir(self.staging)


class Reports(DataSource):
    """``df.write.format("reports").mode("append" or "overwrite").save(folder)``; the folder is one that all tasks share."""

    @classmethod
    def name(cls) -> str:
        return "reports"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> ReportWriter:
        return ReportWriter(self.options["path"].removeprefix("file://"), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Reports)


def save(pieces: DataFrame, folder: str, *, mode: str = "append") -> None:
    """Write the reports of ``pieces`` (report, place, text), each by one task."""
    register(pieces.sparkSession)
    pieces.select("report", F.col("place").cast("long").alias("place"), "text").repartition("report").sortWithinPartitions("report", "place").write.format("reports").mode(mode).save(folder)


def pretty(value: Column, level: int = 0) -> Column:
    """A struct, map or array as JSON, indented by two from ``level`` on, its keys as they are declared; nulls are kept and letters beyond ASCII escaped."""
    pad = "\n" + "  " * level

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: json.dumps(json.loads(t), indent=2).replace("\n", pad), na_action="ignore")

    return F.pandas_udf(run, StringType())(F.to_json(value, {"ignoreNullFields": "false"}))


def json_list(items: DataFrame, by: Sequence[str], order: str, value: Column, report: Column, head: DataFrame, field: str, *, tail: bool = False) -> DataFrame:
    """Pieces of one JSON report for each ``by``: the object of ``head`` (by, head: a struct, and tail: another if ``tail``), with the list ``field`` of all its ``items``' ``value`` as its
    last key, or before those of the tail.

    A report may be of any length: an item is a piece.
    """
    after = F.concat(F.lit(",\n"), F.regexp_replace(pretty(F.col("tail")), r"^\{\n", "")) if tail else F.lit("\n}")
    first = head.select(*by, report.alias("report"), pretty(F.col("head")).alias("text"), F.concat(after, F.lit("\n")).alias("after"))
    each = items.select(*by, F.col(order).cast("long").alias("place"), pretty(value, 2).alias("text"))
    sizes = items.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.max(order).cast("long").alias("most"), F.min(order).cast("long").alias("least"))
    first = first.join(sizes, list(by), "left")
    opened = F.concat(F.regexp_replace("text", r"\n\}$", ""), F.lit(f',\n  "{field}": ['), F.when(F.col("n") > 0, "").otherwise(F.concat(F.lit("]"), "after")))
    heads = first.select("report", F.coalesce(F.col("least") - 1, F.lit(0)).alias("place"), opened.alias("text"))
    listed = each.join(first.select(*by, "report", "least", "most", "after"), list(by))
    between = F.when(F.col("place") > F.col("least"), ",").otherwise("")
    listed = listed.select("report", "place", F.concat(between, F.lit("\n    "), "text", F.when(F.col("place") == F.col("most"), F.concat(F.lit("\n  ]"), "after")).otherwise("")).alias("text"))
    return heads.unionByName(listed)


def findings_json(findings: DataFrame, sets: DataFrame, by: Sequence[str], report: Column) -> DataFrame:
    """Pieces of the reports of ``findings`` (by, tool, category, file, line, severity, code, message), one for each of ``sets`` (by, schema_version, timestamp, repo_root), also of those without any.

    Findings are in the order of category, file, line and code, keys in that of their names, and counts by category come first.
    """
    placed = findings.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("category", "file", "line", "code", "message")))
    sizes = findings.groupBy(*by, "category").agg(F.count(F.lit(1)).alias("n"))  # a row a category
    sizes = sizes.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "n")))).alias("counts"), F.sum("n").alias("total"))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))
    head = sets.join(sizes, list(by), "left").select(
        *by,
        F.struct(F.coalesce("counts", none).alias("by_category")).alias("head"),
        F.struct("repo_root", "schema_version", "timestamp", F.coalesce("total", F.lit(0)).alias("total_findings")).alias("tail"),
    )
    return json_list(placed, by, "place", F.struct("category", "code", "file", "line", "message", "severity", "tool"), report, head, "findings", tail=True)


def scenarios_markdown(scenarios: DataFrame, sets: DataFrame, by: Sequence[str], report: Column) -> DataFrame:
    """Pieces of a table of scenarios for each of ``sets`` (by, schema, timestamp, root, languages, types: an array of type, confidence and evidence), by type and family.

    A piece is a scenario; the first of a type and family has their heading before it.
    """
    group = Window.partitionBy(*by, "type_origin", "family")
    rows = scenarios.withColumns({"n": F.count(F.lit(1)).over(group), "k": F.row_number().over(group.orderBy("place"))})
    rows = rows.withColumn("at", F.row_number().over(Window.partitionBy(*by).orderBy("type_origin", "family", "place")))
    code = lambda c: F.concat(F.lit("`"), c, F.lit("`"))
    title = F.concat(F.lit("### "), code("type_origin"), F.lit(" × "), code("family"), F.lit(" ("), F.col("n").cast("string"), F.lit(")\n\n| id | entry | title |\n|---|---|---|\n"))
    e = F.col("entry_point")
    line = F.concat(F.lit("| "), code("id"), F.lit(" | "), e["file"], F.lit(":"), e["line"].cast("string"), F.lit(" "), code(e["symbol"]), F.lit(" | "), "title", F.lit(" |\n"))
    text = F.concat(F.when(F.col("k") == 1, title).otherwise(""), line, F.when(F.col("k") == F.col("n"), "\n").otherwise(""))
    body = rows.select(*by, F.col("at").cast("long").alias("place"), text.alias("text"))
    sizes = scenarios.groupBy(*by).agg(F.count(F.lit(1)).alias("total"))
    spoken = F.when(F.size("languages") > 0, F.array_join("languages", ", ")).otherwise("(none detected)")
    types = F.transform("types", lambda t: F.concat(F.lit("| "), code(t["type"]), F.lit(" | "), F.format_string("%.2f", t["confidence"]), F.lit(" | "), code(F.coalesce(F.get(t["evidence"], F.lit(0)), F.lit(""))), F.lit(" |\n")))
    types = F.when(F.size("types") > 0, F.concat(F.lit("| Type | Confidence | Evidence (first match) |\n|---|---|---|\n"), F.array_join(types, ""))).otherwise("(no types detected)\n")
    head = F.concat(
        F.lit("# Scenarios — "), "timestamp", F.lit("\n\n**Schema:** "), code("schema"), F.lit("\n**Codebase root:** "), code("root"), F.lit("\n**Languages:** "), spoken,
        F.lit("\n\n## Detected software types\n\n"), types, F.lit("\n## Scenarios ("), F.coalesce("total", F.lit(0)).cast("string"), F.lit(")\n\n"),
    )
    heads = sets.join(sizes, list(by), "left").select(*by, F.lit(0).cast("long").alias("place"), head.alias("text"))
    return heads.unionByName(body.join(sets.select(*by), list(by), "left_semi")).select(report.alias("report"), "place", "text")
