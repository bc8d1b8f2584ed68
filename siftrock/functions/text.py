"""Lines, names, globs and severities as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What ends a line.
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"

#: Severities by the names that tools give them; any other name is a warning.
SEVERITIES = {
    "error": ("error", "fatal", "critical", "high"),
    "warning": ("warning", "warn", "medium", "moderate"),
    "info": ("info", "information", "informational", "note", "help", "hint", "low", "minor", "convention", "style", "refactor", "inventory", "experimental"),
    "nit": ("nit",),
}


def line_array(content: Column) -> Column:
    """The lines of a text; none if it is empty or null, and no empty one after a last line break."""
    parts = F.split(content, LINE_BREAK)
    parts = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return F.coalesce(parts, F.array().cast("array<string>"))


def lines(files: DataFrame, *, path: str = "path", content: str = "content") -> DataFrame:
    """path, line_no (from 1), line."""
    each = files.select(F.col(path).alias("path"), F.posexplode(line_array(F.col(content))).alias("pos", "line"))
    return each.select("path", (F.col("pos") + 1).alias("line_no"), "line")


def all_matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), group)


def first_match(text: Column, pattern: str, group: int = 0) -> Column:
    """The first match, or null. An empty match counts as none."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def looks_like_env(name: Column) -> Column:
    """Upper case, two letters or more, and either an underscore or four letters."""
    return (F.length(name) >= 2) & (name == F.upper(name)) & name.rlike("[A-Z]") & (name.contains("_") | (F.length(name) >= 4))


def severity(raw: Column) -> Column:
    known = F.create_map(*[F.lit(x) for to, names in SEVERITIES.items() for name in names for x in (name, to)])
    return F.coalesce(F.element_at(known, F.lower(F.trim(raw))), F.lit("warning"))


def package_root(specifier: Column) -> Column:
    """The package of a JavaScript import: two parts if scoped, else one."""
    scoped = F.substring_index(specifier, "/", 2)
    return F.when(specifier.startswith("@"), scoped).otherwise(F.substring_index(specifier, "/", 1))


def glob_regex(glob: str) -> str:
    """A path glob as a whole-string pattern: ``**/`` any folders, ``**`` anything, ``*`` and ``?`` within a name."""
    tokens = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    return "^" + re.sub(r"\*\*/|\*\*|\*|\?|[^*?]+", lambda m: tokens.get(m[0]) or re.escape(m[0]), glob) + "$"


def ancestors(path: Column) -> Column:
    """Every folder above a path, outermost first."""
    parts = F.split(path, "/")
    depth = F.size(parts)
    return F.when(depth > 1, F.transform(F.sequence(F.lit(1), depth - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(F.array().cast("array<string>"))
