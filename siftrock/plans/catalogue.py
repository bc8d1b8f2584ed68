"""The queries of the engine's own operators and their SQL. Each runs over its whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftrock.functions.text import lines, severity
from siftrock.operators import classify, entry_points, findings, joins, rules
from siftrock.plans import planted, points, registries, sites, structured
from siftrock.sources.tables import document_files, table

WORD = "[A-Za-z]+"
CONTEXT = rules.Context({"COMMA_END": r",$", "DOT_WORD": r"\. The "}, r"[0-9]", 2, 2)
GLOBS = {"first": ["src1*"], "even": ["src*0", "src*2", "src*4", "src*6", "src*8"], "single": ["src?"]}
OPENINGS = [entry_points.Pattern("text", "opening", (), r"(?m)^(?P<first>[A-Z][a-z]+) (?P<next>[a-z]+)", "{first} {next}"), entry_points.Pattern("text", "mail", (), "(?P<name>[a-z]+)@[a-z]+", "{name}")]
DOMAINS = {"mail": "[a-z]+@[a-z]+", "license": "[Ll]icense", "digits": "[0-9]{4,}"}


# ---- rules on lines


def hardcoded_findings(spark, d):
    return rules.hardcoded(document_files(spark, d))


def by_category(spark, d):
    return findings.by_category(hardcoded_findings(spark, d))


def context_window(spark, d):
    return rules.in_context(document_files(spark, d), CONTEXT).select("path", "line", "code")


def line_counts(spark, d):
    return lines(document_files(spark, d)).groupBy("path").agg(F.count(F.lit(1)).alias("n_lines"), F.max(F.length("line")).alias("longest"))


def followed_within(spark, d):
    """Errors and the next purchase of the same user within ten minutes, by second."""
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    errors = e.where("event_type = 'error'").select("event_id", "user_id", "at")
    return rules.followed_by(errors, e.where("event_type = 'purchase'").select("user_id", "at"), ["user_id"], "at", 600_000_000)


def pattern_sites(spark, d):
    """Matches of two patterns in all documents by line, the operator that finds entry points."""
    return entry_points.sites(document_files(spark, d), OPENINGS).groupBy("path", "rule", "line_no", "symbol").agg(F.count(F.lit(1)).alias("n"))


# ---- joins


def _words(spark, d):
    each = F.explode(F.regexp_extract_all("line", F.lit(WORD), 0))
    return lines(document_files(spark, d)).select("path", "line_no", each.alias("word"))


def _declared(spark, d):
    return table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(WORD), 0)).alias("word"))


def undeclared_words(spark, d):
    return joins.undeclared(_words(spark, d), _declared(spark, d), "word", ["path", "line_no"])


def unused_words(spark, d):
    parts = table(spark, d, "part").select(F.explode(F.regexp_extract_all("p_name", F.lit(WORD), 0)).alias("word"))
    return joins.unused(parts.unionByName(_declared(spark, d)), _words(spark, d), "word")


def glob_lenses(spark, d):
    return joins.with_globs(document_files(spark, d), GLOBS, "source").select("path", "source", "lens")


def gated_tools(spark, d):
    """Nations as tools that need a rich customer of their own in one of two market segments."""
    own = lambda nation, segment: F.concat(F.col(nation).cast("string"), F.lit("/"), segment)
    gates = table(spark, d, "nation").select("n_nationkey", F.explode(F.array(own("n_nationkey", F.lit("BUILDING")), own("n_nationkey", F.lit("NONE")))).alias("need"))
    found = table(spark, d, "customer").where("c_acctbal > 9500").select(own("c_nationkey", F.col("c_mktsegment")).alias("need"))
    return joins.gated(table(spark, d, "nation").select("n_nationkey", "n_name"), gates, found, "n_nationkey", "need")


def parameter_drift(spark, d):
    left, right = F.split("p_name", " "), F.split(F.lower("p_type"), " ")
    missing, ghost = joins.drift(left, right)
    return table(spark, d, "part").select("p_partkey", F.array_join(missing, ",").alias("missing"), F.array_join(ghost, ",").alias("ghost"))


def expanded_scenarios(spark, d):
    points = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("n_nationkey"))
    families = table(spark, d, "nation").join(table(spark, d, "region"), F.expr("n_regionkey = r_regionkey")).select("n_nationkey", F.explode(F.array("n_name", "r_name")).alias("family"))
    return findings.sequential_ids(joins.expanded(points, families, "n_nationkey"), ["family"], ["s_suppkey", "n_nationkey"])


def nearest_signup(spark, d):
    out = joins.nearest_before(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "signup", F.col("event_id"), "signup")
    return out.where("event_type = 'purchase'").select("event_id", "user_id", "signup")


def carried_turn(spark, d):
    """Each turn of a conversation with the last turn up to it that a user spoke."""
    out = joins.nearest_before(table(spark, d, "conversations"), ["conv_id"], ["turn"], F.col("role") == "user", F.col("turn"), "asked")
    return out.select("conv_id", "turn", "role", "asked")


def whole_set_missing(spark, d):
    """Languages, each marked if no toxic document is labelled in the whole set of its documents."""
    toxic = table(spark, d, "labels").where("toxic = 1").select("doc_id")
    docs = table(spark, d, "documents").where("lang IS NOT NULL").select("doc_id", "lang")
    some = docs.join(toxic, "doc_id", "left_semi").select("lang").distinct()
    return docs.select("lang").distinct().join(some, "lang", "left_anti")


# ---- findings


def _verdicts(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    marks = table(spark, d, "labels").select("doc_id", F.expr("CASE WHEN toxic = 1 THEN 'CRITICAL' WHEN quality = 0 THEN 'MINOR' END").alias("severity"), F.lit(True).alias("seen"))
    return docs.join(marks, "doc_id", "left").select(F.col("doc_id").alias("file"), "source", "severity", F.coalesce("seen", F.lit(False)).alias("verified"))


def per_file_table(spark, d):
    return findings.per_file(_verdicts(spark, d))


def gate_verdict(spark, d):
    return findings.gate(_verdicts(spark, d), "source")


def review_verdict(spark, d):
    return findings.review_verdict(_verdicts(spark, d), "source")


def audit_summary(spark, d):
    return findings.audit_summary(_verdicts(spark, d))


def serious_only(spark, d):
    return findings.at_least(_verdicts(spark, d), "MINOR").select("file", "severity")


def keep_first(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_type", "event_id", "value")
    return findings.keep_first(rows, ["user_id", "event_type"], ["event_id"])


def two_counts(spark, d):
    return findings.counts(table(spark, d, "events"), "event_type", "user_id")


def severity_names(spark, d):
    raw = F.when(F.col("o_orderpriority").contains("URGENT"), " Critical ").when(F.col("o_orderpriority").contains("HIGH"), "HIGH").when(F.col("o_orderpriority").contains("LOW"), "low").otherwise(F.col("o_orderpriority"))
    return table(spark, d, "orders").groupBy(severity(raw).alias("severity")).agg(F.count(F.lit(1)).alias("n"))


def confidences(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.countDistinct("lang").alias("k")).select("source", findings.confidence(F.col("k")).alias("confidence"))


def calibration(spark, d):
    s = table(spark, d, "supplier")
    n = F.col("s_suppkey")
    limits = {"requests": (n % 97 + 10, F.lit(8)), "input": (n % 89 * 1000 + 900, F.lit(7000)), "output": (n % 83 * 100 + 90, F.lit(600))}
    return s.select("s_suppkey", *findings.calibrated(0.8, 6, **limits))


def clauses_missing(spark, d):
    """Parts (clauses) that no order line covers."""
    return table(spark, d, "part").join(table(spark, d, "lineitem"), F.expr("p_partkey = l_partkey"), "left_anti").select("p_partkey", "p_brand")


def clause_summary(spark, d):
    status = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("total"), F.count(F.when(F.col("l_linestatus") == "O", 1)).alias("open"), F.count(F.when(F.col("l_discount") > 0.05, 1)).alias("partial"))
    return status


def implementation_rank(spark, d):
    """Suppliers ranked within their nation by balance; ties share a rank."""
    from pyspark.sql import Window

    w = Window.partitionBy("s_nationkey").orderBy(F.desc("s_acctbal"))
    return table(spark, d, "supplier").select("s_suppkey", "s_nationkey", F.rank().over(w).alias("rank"))


def best_match(spark, d):
    """The customer of the largest balance of each nation, the smaller key in ties."""
    best = F.max(F.struct("c_acctbal", (-F.col("c_custkey")).alias("k")))
    return table(spark, d, "customer").groupBy("c_nationkey").agg(best.alias("b")).select("c_nationkey", (-F.col("b.k")).alias("c_custkey"))


# ---- classification


def first_per_language(spark, d):
    return classify.first_files(table(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id").select("doc_id", "lang", "rank")


def domain_evidence(spark, d):
    return classify.evidence(document_files(spark, d), DOMAINS, least={"digits": 3})


def source_breakdown(spark, d):
    docs = table(spark, d, "documents").where("lang IS NOT NULL AND source IS NOT NULL")
    return classify.breakdown(docs.select("source", "lang"), "source", "lang")


def json_fields(spark, d):
    k = F.from_json("props", "struct<k:int>")["k"]
    return table(spark, d, "events").groupBy(k.alias("k")).agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"))


_NAMES = (
    hardcoded_findings, by_category, context_window, line_counts, followed_within, undeclared_words, unused_words, glob_lenses, gated_tools, parameter_drift,
    expanded_scenarios, nearest_signup, carried_turn, whole_set_missing, per_file_table, gate_verdict, review_verdict, audit_summary, serious_only, keep_first,
    two_counts, severity_names, confidences, calibration, clauses_missing, clause_summary, implementation_rank, best_match, first_per_language, domain_evidence,
    source_breakdown, json_fields, pattern_sites,
)


def queries() -> dict:
    return {f.__name__: f for f in _NAMES} | planted.queries() | structured.queries() | registries.queries() | points.queries() | sites.queries()


LINES = """a AS (SELECT doc_id AS path, string_split(text, chr(10)) AS ls FROM documents WHERE text <> ''),
b AS (SELECT path, CASE WHEN ls[len(ls)] = '' THEN list_slice(ls, 1, len(ls) - 1) ELSE ls END AS ls FROM a),
lines AS (SELECT path, unnest(range(1, len(ls) + 1)) AS line_no, unnest(ls) AS line FROM b)"""

_q = lambda p: p.replace("'", "''")
HARDCODED = f"""{LINES},
m AS (
  SELECT path, line_no, regexp_extract(line, '{_q(rules.URL)}') AS url, regexp_extract(line, '{_q(rules.IP)}') AS ip,
    coalesce(nullif(regexp_extract(line, '{_q(rules.PATH)}', 1), ''), regexp_extract(line, '{_q(rules.PATH)}', 2)) AS quoted,
    regexp_extract(line, '{_q(rules.PORT)}', 1) AS port,
    list_filter(list_transform(regexp_extract_all(line, '{rules.NUMBER}', 1), lambda x: ltrim(x, '0')),
      lambda x: (length(x) > 3 OR (length(x) = 3 AND x > '100')) AND x NOT IN {rules.COMMON_NUMBERS})[1] AS number
  FROM lines WHERE NOT regexp_matches(lower(line), '{rules.SAMPLES}') AND NOT regexp_matches(line, '{rules.COMMENT}')),
c AS (
  SELECT *, CASE WHEN url <> '' THEN 'HARDCODED_URL' WHEN regexp_matches(ip, '{rules.IP_PARTS}') AND ip <> '0.0.0.0' THEN 'HARDCODED_IP'
    WHEN quoted <> '' AND NOT starts_with(quoted, '/tmp') THEN 'HARDCODED_PATH' WHEN try_cast(port AS INT) BETWEEN 1 AND 65535 THEN 'HARDCODED_PORT'
    WHEN number IS NOT NULL THEN 'MAGIC_NUMBER' END AS code FROM m),
found AS (
  SELECT path, line_no::INT AS line, 'nit' AS severity, 'hardcoded_config' AS category, code, CASE code
    WHEN 'HARDCODED_URL' THEN 'URL literal `' || url[:80] WHEN 'HARDCODED_IP' THEN 'IPv4 literal `' || ip WHEN 'HARDCODED_PATH' THEN 'Absolute path literal `' || quoted
    WHEN 'HARDCODED_PORT' THEN 'port literal `' || port::INT ELSE 'magic number `' || number END || '`' AS message
  FROM c WHERE code IS NOT NULL)"""
WORDS = f"{LINES}, words AS (SELECT path, line_no, unnest(regexp_extract_all(line, '{WORD}')) AS word FROM lines)"
VERDICTS = """v AS (SELECT d.doc_id AS file, d.source, CASE WHEN l.toxic = 1 THEN 'CRITICAL' WHEN l.quality = 0 THEN 'MINOR' END AS severity, l.doc_id IS NOT NULL AS verified
FROM documents d LEFT JOIN labels l USING (doc_id))"""
COUNTS = ", ".join(f"count(*) FILTER (severity = '{r}') AS {r.lower()}" for r in findings.RANKS)


def oracle_sql() -> dict[str, str]:
    return {
        "hardcoded_findings": f"WITH {HARDCODED} SELECT * FROM found",
        "by_category": f"WITH {HARDCODED} SELECT category, code, count(*) AS n FROM found GROUP BY 1, 2",
        "context_window": f"""WITH {LINES}, t AS (SELECT *, max(regexp_matches(line, '[0-9]')::INT) OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM lines)
            SELECT path, line_no::INT AS line, unnest(['COMMA_END', 'DOT_WORD']) AS code FROM t WHERE near = 0 AND regexp_matches(line, ',$') AND regexp_matches(line, '\\. The ')
            UNION ALL SELECT path, line_no::INT, CASE WHEN regexp_matches(line, ',$') THEN 'COMMA_END' ELSE 'DOT_WORD' END FROM t WHERE near = 0 AND (regexp_matches(line, ',$') <> regexp_matches(line, '\\. The '))""",
        "pattern_sites": f"""WITH {LINES}, m AS (SELECT path, 0 AS rule, line_no, regexp_extract(line, '^[A-Z][a-z]+ [a-z]+') AS symbol FROM lines WHERE regexp_matches(line, '^[A-Z][a-z]+ [a-z]+')
            UNION ALL SELECT path, 1, line_no, unnest(regexp_extract_all(line, '([a-z]+)@[a-z]+', 1)) FROM lines)
            SELECT path::VARCHAR AS path, rule::INT AS rule, line_no::INT AS line_no, symbol, count(*) AS n FROM m GROUP BY ALL""",
        "line_counts": f"WITH {LINES} SELECT path, count(*) AS n_lines, max(length(line))::INT AS longest FROM lines GROUP BY 1",
        "followed_within": "SELECT a.event_id, a.user_id, epoch_us(a.ts) AS at, min(epoch_us(b.ts)) AS next FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'error' AND b.event_type = 'purchase' AND epoch_us(b.ts) BETWEEN epoch_us(a.ts) + 1 AND epoch_us(a.ts) + 600000000 GROUP BY 1, 2, 3",
        "undeclared_words": f"WITH {WORDS} SELECT word, min((path, line_no))[1] AS path, min((path, line_no))[2]::INT AS line_no, count(*) AS sites FROM words WHERE word NOT IN (SELECT unnest(regexp_extract_all(text, '{WORD}')) FROM benchmark) GROUP BY 1",
        "unused_words": f"WITH {WORDS}, d AS (SELECT unnest(regexp_extract_all(p_name, '{WORD}')) AS word FROM part UNION SELECT unnest(regexp_extract_all(text, '{WORD}')) FROM benchmark) SELECT word FROM d WHERE word NOT IN (SELECT word FROM words)",
        "glob_lenses": "SELECT doc_id AS path, source, lens FROM documents JOIN (VALUES ('first', 'src1*'), ('even', 'src*[02468]'), ('single', 'src?')) g(lens, pattern) ON source GLOB pattern",
        "gated_tools": "SELECT n_nationkey, n_name, EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 9500 AND c_mktsegment IN ('BUILDING', 'NONE')) AS fires FROM nation",
        "parameter_drift": """WITH p AS (SELECT p_partkey, string_split(p_name, ' ') AS l, string_split(lower(p_type), ' ') AS r FROM part)
            SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(l, lambda x: NOT list_contains(r, x)))), ',') AS missing, array_to_string(list_sort(list_distinct(list_filter(r, lambda x: NOT list_contains(l, x)))), ',') AS ghost FROM p""",
        "expanded_scenarios": """WITH f AS (SELECT n_nationkey, unnest([n_name, r_name]) AS family FROM nation JOIN region ON n_regionkey = r_regionkey),
            e AS (SELECT DISTINCT s_suppkey, n_nationkey, family FROM supplier JOIN f ON s_nationkey = n_nationkey)
            SELECT s_suppkey, n_nationkey, family, printf('SCEN-%04d', row_number() OVER (ORDER BY family, s_suppkey, n_nationkey)) AS id FROM e""",
        "nearest_signup": "SELECT event_id, user_id, signup FROM (SELECT *, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS signup FROM events) WHERE event_type = 'purchase'",
        "carried_turn": "SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS asked FROM conversations",
        "whole_set_missing": "SELECT DISTINCT lang FROM documents o WHERE lang IS NOT NULL AND lang NOT IN (SELECT d.lang FROM documents d JOIN labels l USING (doc_id) WHERE l.toxic = 1 AND d.lang IS NOT NULL)",
        "per_file_table": f"WITH {VERDICTS} SELECT file, {COUNTS} FROM v GROUP BY 1",
        "gate_verdict": f"WITH {VERDICTS}, g AS (SELECT source, {COUNTS}, count(*) FILTER (NOT verified) AS unverified FROM v GROUP BY 1) SELECT *, CASE WHEN critical + major + unverified = 0 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM g",
        "review_verdict": f"WITH {VERDICTS}, g AS (SELECT source, {COUNTS} FROM v GROUP BY 1) SELECT source, critical + major AS must_fix, minor AS should_fix, nit, CASE WHEN critical + major > 0 THEN 'FAIL' WHEN minor > 0 THEN 'CONDITIONAL' ELSE 'PASS' END AS verdict FROM g",
        "audit_summary": f"WITH {VERDICTS}, g AS (SELECT {COUNTS}, count(DISTINCT file) AS files FROM v) SELECT critical || ' CRITICAL, ' || major || ' MAJOR, ' || minor || ' MINOR, ' || nit || ' NIT across ' || files || ' files' AS summary FROM g",
        "serious_only": f"WITH {VERDICTS} SELECT file, severity FROM v WHERE severity IN ('CRITICAL', 'MAJOR', 'MINOR')",
        "keep_first": "SELECT user_id, event_type, min(event_id) AS event_id, arg_min(value, event_id) AS value FROM events GROUP BY 1, 2",
        "two_counts": "SELECT CASE WHEN grouping(event_type) = 0 THEN 'event_type' ELSE 'user_id' END AS dimension, coalesce(event_type, user_id::VARCHAR) AS value, count(*) AS n FROM events GROUP BY GROUPING SETS ((event_type), (user_id))",
        "severity_names": "SELECT CASE WHEN o_orderpriority LIKE '%URGENT%' OR o_orderpriority LIKE '%HIGH%' THEN 'error' WHEN o_orderpriority LIKE '%LOW%' THEN 'info' ELSE 'warning' END AS severity, count(*) AS n FROM orders GROUP BY 1",
        "confidences": "SELECT source, round(least(0.98::DOUBLE, 0.85::DOUBLE + 0.04::DOUBLE * count(DISTINCT lang)), 3) AS confidence FROM documents GROUP BY 1",
        "calibration": """WITH r AS (SELECT s_suppkey, (s_suppkey % 97 + 10)::DOUBLE / 8 AS a, (s_suppkey % 89 * 1000 + 900)::DOUBLE / 7000 AS b, (s_suppkey % 83 * 100 + 90)::DOUBLE / 600 AS c FROM supplier),
            f AS (SELECT *, floor(0.8::DOUBLE * least(a, b, c)) AS raw, least(a, b, c) AS low FROM r)
            SELECT s_suppkey, greatest(1, least(6, raw))::INT AS concurrency, CASE WHEN raw >= 6 THEN 'concurrency' WHEN a = low THEN 'requests' WHEN b = low THEN 'input' ELSE 'output' END AS binding FROM f""",
        "clauses_missing": "SELECT p_partkey, p_brand FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey)",
        "clause_summary": "SELECT l_returnflag, count(*) AS total, count(*) FILTER (l_linestatus = 'O') AS open, count(*) FILTER (l_discount > 0.05) AS partial FROM lineitem GROUP BY 1",
        "implementation_rank": "SELECT s_suppkey, s_nationkey, rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC)::INT AS rank FROM supplier",
        "best_match": "SELECT c_nationkey, c_custkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) = 1",
        "first_per_language": "SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id)::INT AS rank FROM documents QUALIFY rank <= 200",
        "domain_evidence": "SELECT domain, count(*) AS n, min(doc_id) AS first FROM documents JOIN (VALUES ('mail', '[a-z]+@[a-z]+', 1), ('license', '[Ll]icense', 1), ('digits', '[0-9]{4,}', 3)) p(domain, pattern, least) ON regexp_matches(text, pattern) GROUP BY domain, least HAVING count(*) >= least",
        "source_breakdown": "WITH s AS (SELECT source, lang, count(*) AS n FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY 1, 2) SELECT source, string_agg(lang || ': ' || n || ' file' || CASE WHEN n = 1 THEN '' ELSE 's' END, ', ' ORDER BY n DESC, lang) AS parts FROM s GROUP BY 1",
        "json_fields": "SELECT (props->>'k')::INT AS k, count(*) AS n, min(event_id) AS first FROM events GROUP BY 1",
    } | planted.oracle_sql() | structured.oracle_sql() | registries.oracle_sql() | points.oracle_sql() | sites.oracle_sql()
