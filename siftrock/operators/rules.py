"""Line rules: DataFrames of files in, findings out.

``files`` has path and content, of any types that print; findings have path, line, severity, category, code and message.
Rules on single lines are narrow: lines are exploded, matched and filtered within a task. Rules that look at the lines
around one are too: they work on the file's array of lines. Only what matches is ever shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftrock.functions.text import all_matches, first_match, line_array, lines, looks_like_env
from siftrock.operators.nesting import sends_after_close

# ---- fixed values

#: Lines that mention these are samples, and those that begin with a comment mark are left alone.
SAMPLES = r"example\.com|localhost|127\.0\.0\.1|::1"
COMMENT = r"^\s*(?:#|//)"
URL = r"https?://[\w.:/\-?&=#@%]+"
IP = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
IP_PARTS = r"^(?:(?:\d{1,2}|[01]\d\d|2[0-4]\d|25[0-5])(?:\.|$)){4}$"
PATH = r"""\"\s*(/[A-Za-z][\w./\-]+/[\w./\-]+)\s*\"|'(/[A-Za-z][\w./\-]+/[\w./\-]+)'"""
PORT = r"""(?i)['"]?\bport\b['"]?\s*[:=]\s*(\d{2,5})\b"""
NUMBER = r"\b(\d{3,})\b"
COMMON_NUMBERS = ("200", "201", "204", "301", "302", "400", "401", "403", "404", "500", "502", "503", "1000", "1024", "8080")
ENV_NAME = "[A-Z_][A-Z0-9_]*"
ENV_REFERENCES = (
    rf"""os\.environ\.get\(\s*['"]({ENV_NAME})['"]""",
    rf"""os\.getenv\(\s*['"]({ENV_NAME})['"]""",
    rf"""os\.environ\[\s*['"]({ENV_NAME})['"]\]""",
    rf"""process\.env\.({ENV_NAME})""",
    rf"""process\.env\[\s*['"]({ENV_NAME})['"]\]""",
    rf"""env::var\(\s*['"]({ENV_NAME})['"]""",
    rf"""os\.Getenv\(\s*['"]({ENV_NAME})['"]""",
    rf"""\bENV\[\s*['"]({ENV_NAME})['"]\]""",
    r"""\$\{?([A-Z][A-Z0-9_]{1,})\}?\b""",
)
BANNERS = (
    r"@generated\b",
    r"Code generated by",
    r"(?m)^// DO NOT EDIT\b",
    r"(?m)^# DO NOT EDIT\b",
    r"<!-- DO NOT EDIT -->",
    r"/\*\s*\*\s*AUTOGENERATED FILE\s*\*",
    r"\bautogenerated\b",
    r"This file is automatically generated",
)
#: Every banner holds one of these.
BANNER_WORDS = "generated|DO NOT EDIT|AUTOGENERATED FILE"
OLD_NAME = r"\b([A-Za-z_][A-Za-z0-9_]{1,}(?:_v\d+|_old|_new|_legacy|_deprecated|_v2))\b"
TENANT = r"tenant_id|tenantId|org_id|orgId|organization_id|organizationId|workspace_id|workspaceId|account_id|accountId|tenant"
QUERIES = {
    "SQLALCHEMY_FILTER_BY": r"\.filter_by\([^)]*\buser_id\s*=",
    "SQLALCHEMY_FILTER": r"\.filter\([^)]*\buser_id\s*=",
    "DJANGO_FILTER": r"\.objects\.filter\([^)]*\buser\s*=",
    "KYSELY_WHERE": r"\.where\(\s*\{?\s*userId\b",
    "PRISMA_WHERE": r"where\s*:\s*\{\s*[^}]*userId\b",
    "RAW_SQL_WHERE_USER": r"WHERE\s+\w*user_id\s*[=<>]",
}
CACHES = r"\b(?:cache|redis|memcache|mc|kv|store)\.(?:get|set|delete|hget|hset|setex)\(|\b(?:Cache|Redis)\.(?:get|set|delete)\(|\bredisClient\.(?:get|set|hGet|hSet|setEx)\("
SIGNATURES = r"^def\s+\w+\s*\([^)]*\buser_id\b|^async\s+def\s+\w+\s*\([^)]*\buser_id\b|function\s+\w+\s*\([^)]*\buserId\b|\bfn\s+\w+\s*\([^)]*\buser_id\b"
NOT_PRODUCTION = r"""(?i)if\s*\(?\s*(?:process\.env\.NODE_ENV|os\.environ\[?["']ENV["']\]?|os\.environ\.get\(["']ENV["']\)|NODE_ENV)\s*(?:!==|!=|<>)\s*["'](?:production|prod)["']\s*\)?"""
STAND_IN = r"(?i)\b(mock|stub|fake|dummy)"
GOROUTINE = r"^\s*go\s+\w"
SYNC = r"sync\.|wg\.Add|wg\.Done|wg\.Wait|chan |errgroup\.|context\."
NUMBER_COMMENT = r"^\s*[\w.\[\]]+\s*[+\-*/%]?=\s*(-?\d+(?:\.\d+)?)\s*[\s,)\]}]*\s*#\s*(.+)$"
ANY_NUMBER = r"-?\d+(?:\.\d+)?"


def _finding(rows: DataFrame, code, severity, category, message: Column) -> DataFrame:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return rows.select("path", F.col("line_no").alias("line"), lit(severity).alias("severity"), lit(category).alias("category"), lit(code).alias("code"), message.alias("message"))


def _is(code, severity, category, message: Column) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(lit(code).alias("code"), lit(severity).alias("severity"), lit(category).alias("category"), message.alias("message"))


def _in_lines(files: DataFrame, *rules) -> DataFrame:
    """What the rules find in single lines, in one reading. A rule gives columns that it takes from a line, each computed once a line, and the array of what follows from them."""
    taken = {name: column for _, columns, _ in rules for name, column in columns.items()}
    each = lines(files).select("path", "line_no", *[c.alias(name) for name, c in taken.items()])
    found = F.concat(*[F.when(holds, then).otherwise(F.array().cast(_FOUND)) for holds, _, then in rules])
    # outer: the optimizer would look into the arrays twice, once to see whether they are empty
    return each.select("path", F.col("line_no").alias("line"), F.explode_outer(found).alias("f")).where("f IS NOT NULL").select("path", "line", "f.severity", "f.category", "f.code", "f.message")


_FOUND = "array<struct<code:string,severity:string,category:string,message:string>>"

# ---- single lines


def _hardcoded():
    line = F.col("line")
    fit = ~F.lower("line").rlike(SAMPLES) & ~line.rlike(COMMENT)
    quoted = F.coalesce(first_match(line, PATH, 1), first_match(line, PATH, 2))
    bare = F.transform(all_matches(line, NUMBER, 1), lambda x: F.ltrim(x, F.lit("0")))
    odd = F.filter(bare, lambda x: ((F.length(x) > 3) | ((F.length(x) == 3) & (x > "100"))) & ~x.isin(*COMMON_NUMBERS))
    taken = {"url": first_match(line, URL), "ip": first_match(line, IP), "quoted": F.when(line.rlike("[\"']"), quoted), "port": first_match(line, PORT, 1), "number": F.get(odd, F.lit(0))}
    kinds = (
        ("HARDCODED_URL", F.col("url").isNotNull(), F.concat(F.lit("URL literal `"), F.substring("url", 1, 80))),
        ("HARDCODED_IP", F.col("ip").rlike(IP_PARTS) & (F.col("ip") != "0.0.0.0"), F.concat(F.lit("IPv4 literal `"), "ip")),
        ("HARDCODED_PATH", ~F.col("quoted").startswith("/tmp"), F.concat(F.lit("Absolute path literal `"), "quoted")),
        ("HARDCODED_PORT", F.col("port").cast("int").between(1, 65535), F.concat(F.lit("port literal `"), F.col("port").cast("int").cast("string"))),
        ("MAGIC_NUMBER", F.col("number").isNotNull(), F.concat(F.lit("magic number `"), "number")),
    )
    code = message = None
    for name, holds, text in kinds:
        code = F.when(holds, name) if code is None else code.when(holds, name)
        message = F.when(holds, text) if message is None else message.when(holds, text)
    return code.isNotNull(), {n: F.when(fit, c) for n, c in taken.items()}, F.array(_is(code, "nit", "hardcoded_config", F.concat(message, F.lit("`"))))


def _old_names():
    names = F.when(F.col("line").rlike(OLD_NAME), F.array_distinct(all_matches(F.col("line"), OLD_NAME, 1)))
    return F.col("names").isNotNull(), {"names": names}, F.transform("names", lambda n: _is("DEPRECATED_NAME_SUFFIX", "nit", "orphan_naming", n))


def _schema_changes():
    line, migration = F.col("line"), F.col("path").cast("string").rlike(r"(?:^|/)(?:migrations?|alembic|versions)/")
    code = F.when(line.rlike(r"(?i)^\s*ALTER\s+TABLE\b"), "ALTER_TABLE_OUTSIDE_MIGRATION").when(line.rlike(r"(?i)^\s*DROP\s+TABLE\b"), "DROP_TABLE_OUTSIDE_MIGRATION")
    taken = {"change": F.when(~migration, code), "line": line}
    return F.col("change").isNotNull(), taken, F.array(_is(F.col("change"), "warning", "schema_change_outside_migration", F.trim("line")))


def _comment_contradictions():
    line, value = F.col("line"), F.regexp_extract("line", NUMBER_COMMENT, 1)
    others = F.filter(all_matches(F.regexp_extract("line", NUMBER_COMMENT, 2), ANY_NUMBER), lambda x: x != F.regexp_extract("line", NUMBER_COMMENT, 1))
    fits = line.rlike(NUMBER_COMMENT)
    taken = {"value": F.when(fits, value), "others": F.when(fits, others)}
    message = F.concat("value", F.lit(": "), F.array_join("others", ", "))
    return F.size("others") > 0, taken, F.array(_is("COMMENT_CONTRADICTS_LITERAL", "nit", "comment_contradicts_literal", message))


def hardcoded(files: DataFrame) -> DataFrame:
    """The first of url, ip, path, port and number that a line holds, one finding a line."""
    return _in_lines(files, _hardcoded())


def names_in_lines(files: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """path, line_no, name: the names that any pattern's first group gives, once a line."""
    found = F.array_distinct(F.flatten(F.array(*[all_matches(F.col("line"), p, 1) for p in patterns])))
    return lines(files).select("path", "line_no", F.explode(found).alias("name"))


def env_references(files: DataFrame) -> DataFrame:
    return names_in_lines(files, ENV_REFERENCES).where(looks_like_env(F.col("name")))


def old_names(files: DataFrame) -> DataFrame:
    return _in_lines(files, _old_names())


def banners(files: DataFrame) -> DataFrame:
    """Files whose first 50 lines hold a generator's banner, reported at line 1."""
    head = F.array_join(F.slice(line_array(F.col("content")), 1, 50), "\n")
    said = F.coalesce(*[first_match(F.col("head"), p) for p in BANNERS])
    # heads by a generator: filters on them would go below a projection and cut every file again for each pattern
    heads = files.where(F.col("content").cast("string").rlike(BANNER_WORDS)).select("path", F.explode_outer(F.array(head)).alias("head"))
    rows = heads.select("path", F.lit(1).alias("line_no"), said.alias("said")).where("said IS NOT NULL")
    return _finding(rows, "GENERATED_BANNER_PRESENT", "info", "generated_drift", F.col("said"))


def schema_changes(files: DataFrame) -> DataFrame:
    return _in_lines(files, _schema_changes())


def comment_contradictions(files: DataFrame) -> DataFrame:
    """A number is assigned and the comment beside it names another; compared as text."""
    return _in_lines(files, _comment_contradictions())


# ---- a line and those around it


@dataclass(frozen=True)
class Context:
    """Lines that match a trigger (code -> pattern) count if ``marker`` is, or isn't, met from ``before`` lines above to ``after`` below."""

    triggers: dict[str, str]
    marker: str
    before: int
    after: int
    wanted: bool = False
    severity: str = "warning"
    category: str = "context"


TENANT_QUERIES = Context(QUERIES, TENANT, 2, 2, category="query_missing_tenant")
TENANT_CACHES = Context({"CACHE_KEY_NO_TENANT": CACHES}, TENANT, 2, 2, category="cache_missing_tenant")
TENANT_SIGNATURES = Context({"FN_SIG_NO_TENANT": SIGNATURES}, TENANT, 0, 7, severity="nit", category="signature_missing_tenant")
STAND_INS = Context({"MOCK_FALLBACK": NOT_PRODUCTION}, STAND_IN, 0, 9, wanted=True, category="mock_in_prod_fallback")
GOROUTINES = Context({"GOROUTINE_NO_SYNC": GOROUTINE}, SYNC, 3, 3, category="goroutine_no_sync")


def in_context(files: DataFrame, *rules: Context) -> DataFrame:
    """What the rules find, in one reading."""
    split = files.select("path", line_array(F.col("content")).alias("_lines"))

    def hits(rule: Context):
        def look(x, i):
            codes = F.array_compact(F.array(*[F.when(x.rlike(p), c) for c, p in rule.triggers.items()]))
            start = F.greatest(i + 1 - rule.before, F.lit(1))
            near = F.slice(F.col("_lines"), start, i + rule.after + 2 - start)
            met = F.exists(near, lambda y: y.rlike(rule.marker))
            holds = (F.size(codes) > 0) & (met if rule.wanted else ~met)
            return F.struct((i + 1).alias("line_no"), x.alias("line"), F.when(holds, codes).alias("codes"), F.lit(rule.severity).alias("severity"), F.lit(rule.category).alias("category"))

        return F.filter(F.transform("_lines", look), lambda h: h.codes.isNotNull())

    found = split.select("path", F.explode_outer(F.concat(*map(hits, rules))).alias("h")).where("h IS NOT NULL")  # outer: see _in_lines
    rows = found.select("path", "h.line_no", "h.line", "h.severity", "h.category", F.explode("h.codes").alias("code"))
    return _finding(rows, F.col("code"), F.col("severity"), F.col("category"), F.substring(F.trim("line"), 1, 120))


def followed_by(first: DataFrame, then: DataFrame, keys: list[str], place: str, within: int) -> DataFrame:
    """``first`` with ``next``: the nearest ``place`` of ``then`` with equal keys, 1 to ``within`` behind. Both sides hold matches only."""
    a, b = first.alias("a"), then.alias("b")
    near = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys] + [F.col(f"b.{place}").between(F.col(f"a.{place}") + 1, F.col(f"a.{place}") + within)]
    return a.join(b, near).groupBy(*[F.col(f"a.{c}").alias(c) for c in first.columns]).agg(F.min(f"b.{place}").alias("next"))


def all_rules(files: DataFrame) -> DataFrame:
    """Every rule's findings, one DataFrame. Files are read four times, however many rules there are: by lines, by lines and those around them, for banners and for channels."""
    out = _in_lines(files, _hardcoded(), _old_names(), _schema_changes(), _comment_contradictions())
    out = out.unionByName(in_context(files, TENANT_QUERIES, TENANT_CACHES, TENANT_SIGNATURES, STAND_INS, GOROUTINES))
    return out.unionByName(banners(files)).unionByName(sends_after_close(files))
