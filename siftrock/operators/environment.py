"""Environment variables that are used and not declared, or declared and not used.

Declarations are the names of ``.env`` files and of ``environment:`` blocks in compose files; references are those of
``rules.env_references``. A change set's references are held against the declarations of the whole tree, so unused declarations are only
reported for whole trees.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftrock.functions.text import lines, looks_like_env
from siftrock.operators import joins, rules

# Names of the files that declare variables.
DOTENV = (".env", ".env.example", ".env.sample", ".env.template", ".env.local", ".env.dist", ".env.development", ".env.production", ".env.test")
COMPOSE = ("docker-compose.yml", "docker-compose.yaml", "compose.yml", "compose.yaml")


def _named(files: DataFrame, names: tuple[str, ...]) -> DataFrame:
    return files.where(F.element_at(F.split(F.col("path").cast("string"), "/"), -1).isin(*names))


def dotenv(files: DataFrame) -> DataFrame:
    """path, line_no, name of each ``NAME=value`` line, with or without ``export``."""
    line = F.trim(F.regexp_replace(F.trim("line"), r"^export ", ""))
    rows = lines(_named(files, DOTENV)).where(F.trim("line") != "").where(~F.ltrim("line").startswith("#")).where(line.contains("="))
    return rows.select("path", "line_no", F.trim(F.substring_index(line, "=", 1)).alias("name")).where(looks_like_env(F.col("name")))


def compose(files: DataFrame) -> DataFrame:
    """path, line_no, name of each entry of an ``environment:`` block: lines that are indented deeper than its head, up to the first that isn't.

    A line's head is the last one before it, and it belongs to that block if no line between them is indented as little; both are
    windows over one file's lines.
    """
    before = Window.partitionBy("path").orderBy("line_no")
    indent = F.length("line") - F.length(F.ltrim("line"))
    rows = lines(_named(files, COMPOSE)).withColumns({"indent": indent, "head": F.ltrim("line").startswith("environment:")})
    rows = rows.where(F.trim("line") != "")
    rows = rows.withColumn("block", F.last(F.when(F.col("head"), F.struct("line_no", "indent")), ignorenulls=True).over(before)).where("block IS NOT NULL")
    inside = Window.partitionBy("path", "block.line_no").orderBy("line_no")
    rows = rows.withColumn("least", F.min(F.when(~F.col("head"), F.col("indent"))).over(inside)).where("NOT head AND least > block.indent")
    entry = F.regexp_replace(F.trim("line"), r"^- ", "")
    name = F.trim(F.substring_index(F.substring_index(entry, "=", 1), ":", 1))
    return rows.select("path", "line_no", name.alias("name")).where(looks_like_env(F.col("name")))


def declarations(files: DataFrame) -> DataFrame:
    return dotenv(files).unionByName(compose(files))


def environment_drift(references: DataFrame, declared: DataFrame, *, whole: bool = True) -> DataFrame:
    """Findings at the first site of each name that only one side has. ``whole``: the references are those of the whole tree."""

    def finding(rows: DataFrame, severity: str, code: str, message) -> DataFrame:
        return rows.select("path", F.col("line_no").alias("line"), F.lit(severity).alias("severity"), F.lit("env_var_drift").alias("category"), F.lit(code).alias("code"), message.alias("message"))

    used = joins.undeclared(references, declared, "name", ["path", "line_no"])
    out = finding(used, "warning", "USED_IN_CODE_NOT_DOCUMENTED", F.format_string("Env var '%s' referenced in code but not declared in any .env* / compose env block", "name"))
    if whole:
        idle = joins.undeclared(declared, references, "name", ["path", "line_no"])
        out = out.unionByName(finding(idle, "nit", "DOCUMENTED_NOT_USED", F.format_string("Env var '%s' declared in %s but never referenced from code", "name", "path")))
    return out


def drift_of(files: DataFrame, changed: DataFrame | None = None) -> DataFrame:
    """Drift over ``files``, or of the references in the ``changed`` ones against the declarations of all."""
    return environment_drift(rules.env_references(files if changed is None else changed), declarations(files), whole=changed is None)
