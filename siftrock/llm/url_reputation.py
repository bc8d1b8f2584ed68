"""URL filter: explicit host and path rules, and empirical-Bayes host reputation where no rule fits.

Labelled page outcomes (1 = bad) are counted for each host, then shrunk level by level:
all pages -> suffix -> registered domain -> host. At each level the outcomes of a unit are
beta-binomial around its parent's posterior mean; the prior's strength comes from the
units' overdispersion by the method of moments. Each level is written, and its strength, one number, is read before
the next is planned. A host is blocked when the lower bound of its posterior bad rate exceeds the threshold; the bound is the
posterior mean less ``z`` posterior standard deviations, the normal approximation of the beta quantile of that level.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule
and gets the reputation of the empty host. Null or other than 0/1 outcomes are ignored.
Repeated rows are judged and counted each. Without any labelled page every host is allowed: the
overall rate is then 0.5, and its bound is below that.
Extra columns stay, whatever their names; outputs (host, path, rule, verdict) replace columns of the same name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import free_name, written

RESULT = ("host", "path", "rule", "verdict")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (verdict, host/path): fixed values of the contract.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)

#: Second-level labels under which names are registered in two-letter suffixes (``co.uk``).
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")


def url_host(url: Column) -> Column:
    rest = F.regexp_extract(url, r"^[\s\S]*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def domain_parts(host: Column) -> tuple[Column, Column]:
    """(suffix, registered domain). A name under a two-letter country suffix keeps its second level
    in the suffix; an IPv4 address is its own domain under the empty suffix."""
    ip = host.rlike(r"^[0-9.]+$")
    suffix = F.when(ip, F.lit("")).otherwise(
        F.regexp_extract(host, rf"(?:^|\.)((?:(?:{'|'.join(SECOND_LEVEL)})\.[a-z]{{2}})|[^.]*)$", 1)
    )
    labels = F.size(F.split(suffix, r"\.")) + 1
    domain = F.when(ip, host).otherwise(F.call_function("substring_index", host, F.lit("."), -labels))
    return suffix, domain


def rule_columns(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, else nulls. Rules are a bounded parameter and become one CASE."""
    rule = verdict = None
    for kind, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        rule_host, _, rule_path = text.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith("/" + rule_path)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    if rule is None:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return rule, verdict


def _strength(units: DataFrame, parent: str, low: float, high: float) -> float:
    """The beta prior's strength by moments of the units' counts around the parent's rate: three sums, of which a number comes back.

    With y ~ BetaBinomial(n, p, k) and rho = 1/(k+1): E[(y-np)^2] = np(1-p)(1+(n-1)rho).
    """
    p = F.col(parent)
    sums = units.agg(
        F.sum((F.col("bad") - F.col("n") * p) ** 2).alias("spread"),
        F.sum(F.col("n") * p * (1 - p)).alias("binomial"),
        F.sum(F.col("n") * (F.col("n") - 1) * p * (1 - p)).alias("extra"),
    ).first()
    if not sums.extra or sums.extra <= 0:
        return low
    rho = (sums.spread - sums.binomial) / sums.extra
    return high if rho <= 0 else min(high, max(low, 1 / rho - 1))


def host_reputation(outcomes: DataFrame, *, judged: DataFrame | None = None, z: float = 1.645, min_strength: float = 2.0, max_strength: float = 200.0) -> DataFrame:
    """Per host: n, bad, posterior mean and its lower bound. Hosts of ``judged`` (host) without outcomes have n = bad = 0 and
    the posterior of their domain, else of their suffix, else of all pages as their prior.

    outcomes: host string, outcome int (1 = bad). Hosts grow with the data and are aggregated with
    map-side partial sums; each level is an equi-join of aggregates, none is collected.
    """
    labelled = outcomes.where(F.col("outcome").isin(0, 1) & F.col("host").isNotNull())
    hosts = labelled.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("outcome").cast("long")).alias("bad"))
    if judged is not None:
        others = judged.where(F.col("host").isNotNull()).select("host", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("bad"))
        hosts = hosts.unionByName(others).groupBy("host").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffix, domain = domain_parts(F.col("host"))
    hosts = written(hosts.withColumns({"suffix": suffix, "domain": domain}), "hosts")
    known = hosts.where("n > 0")
    domains = written(known.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "domains")
    suffixes = written(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "suffixes")
    total = suffixes.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    overall = (total.bad + 1) / (total.n + 2) if total.n else 0.5

    def posterior(units: DataFrame, parent: str):
        k = F.lit(_strength(units, parent, min_strength, max_strength))
        return k, (F.col("bad") + k * F.col(parent)) / (F.col("n") + k)

    suffixes = suffixes.withColumn("p0", F.lit(overall))
    suffixes = suffixes.select("suffix", posterior(suffixes, "p0")[1].alias("p1"))
    domains = written(domains.join(suffixes, "suffix"), "domain-priors")
    domains = domains.select("suffix", "domain", posterior(domains, "p1")[1].alias("p2"))
    hosts = hosts.join(domains, ["suffix", "domain"], "left").join(suffixes, "suffix", "left")
    hosts = written(hosts.withColumn("prior", F.coalesce("p2", "p1", F.lit(overall))), "host-priors")
    k, mean = posterior(hosts.where("n > 0"), "prior")
    hosts = hosts.select("host", "n", "bad", mean.alias("mean"))
    sd = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + k + 1))
    return hosts.withColumn("lower", F.col("mean") - z * sd)


def judge(pages: DataFrame, outcomes: DataFrame, *, rules: Sequence[tuple[str, str]] = RULES, threshold: float = 0.5, url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule and verdict: the longest rule's, else block where the host's posterior
    lower bound exceeds ``threshold``. Hosts without labelled pages are judged by their domain, else suffix, else all pages."""
    judged = pages.withColumns({"host": url_host(F.col(url)), "path": url_path(F.col(url))})
    rule, by_rule = rule_columns(F.col("host"), F.col("path"), rules)
    judged = judged.withColumns({"rule": rule, "verdict": by_rule})
    mark = free_name(judged, "bad_host")
    # a host in judged and one in bad: all rows of a page are its host's, so a hot host is an ordinary skewed join
    bad = host_reputation(outcomes, judged=judged).where(F.col("lower") > threshold).select("host", F.lit("block").alias(mark))
    judged = judged.join(bad, "host", "left").withColumn("verdict", F.coalesce(F.col("verdict"), F.col(mark), F.lit("allow")))
    return judged.select(*[c for c in pages.columns if c not in RESULT], *RESULT)


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Outcomes of pages whose url ends in the id of a labelled document: 1 where that document is of low quality."""
    doc_id = F.regexp_extract(url_path(F.col("url")), r"/([0-9]+)[^/]*/?$", 1).try_cast("long")  # too long for an id: null
    ids = pages.select(url_host(F.col("url")).alias("host"), doc_id.alias("doc_id"))
    marks = labels.groupBy("doc_id").agg(F.max(1 - F.col("quality")).alias("outcome"))
    return ids.where(F.col("doc_id").isNotNull()).join(marks, "doc_id").select("host", "outcome")


def op10(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return judge(pages, labelled_pages(pages, labels)).select("page_id", "host", "path", "rule", "verdict")


ORACLE = r"""
WITH u AS (
  SELECT page_id, url,
    CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
p AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
r(verdict, rule, rhost, rpath) AS (VALUES
  ('allow', 'com/', 'com', '/'), ('block', 'example.com/en/', 'example.com', '/en/'),
  ('allow', 'www.example.com/en/', 'www.example.com', '/en/'), ('block', 'net/es/', 'net', '/es/'), ('block', 'net/fr/', 'net', '/fr/')),
fit AS (
  SELECT p.page_id, arg_max(r.rule, length(r.rule)) AS rule, arg_max(r.verdict, length(r.rule)) AS verdict
  FROM p JOIN r ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath) GROUP BY 1),
m AS (SELECT doc_id, max(1 - quality) AS outcome FROM labels GROUP BY 1),
o AS (
  SELECT p.host, m.outcome FROM p JOIN m ON m.doc_id = try_cast(regexp_extract(p.path, '/([0-9]+)[^/]*/?$', 1) AS BIGINT)
  WHERE m.outcome IN (0, 1)),
h0 AS (SELECT p.host, coalesce(max(o.n), 0)::DOUBLE AS n, coalesce(max(o.bad), 0)::DOUBLE AS bad
  FROM p LEFT JOIN (SELECT host, count(*) AS n, sum(outcome) AS bad FROM o GROUP BY 1) o ON o.host = p.host GROUP BY 1),
h1 AS (
  SELECT *, CASE WHEN regexp_matches(host, '^[0-9.]+$') THEN '' ELSE
    regexp_extract(host, '(?:^|\.)((?:(?:ac|co|com|edu|gov|net|org)\.[a-z]{2})|[^.]*)$', 1) END AS suffix FROM h0),
h AS (
  SELECT *, CASE WHEN regexp_matches(host, '^[0-9.]+$') THEN host
    ELSE array_to_string(list_slice(string_split(host, '.'), -(len(string_split(suffix, '.')) + 1), -1), '.') END AS domain FROM h1),
d AS (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM h WHERE n > 0 GROUP BY 1, 2),
s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY 1),
t AS (SELECT coalesce((sum(bad) + 1) / (sum(n) + 2), 0.5) AS p FROM s),
ks AS (SELECT sum((bad - n * p) ** 2) AS a, sum(n * p * (1 - p)) AS b, sum(n * (n - 1) * p * (1 - p)) AS c FROM s, t),
s1 AS (
  SELECT suffix, (bad + k * p) / (n + k) AS p1 FROM s, t,
    (SELECT least(200, greatest(2, CASE WHEN NOT c > 0 OR c IS NULL THEN 2 WHEN (a - b) / c <= 0 THEN 200 ELSE 1 / ((a - b) / c) - 1 END)) AS k FROM ks)),
dj AS (SELECT d.*, s1.p1 FROM d JOIN s1 USING (suffix)),
kd AS (SELECT sum((bad - n * p1) ** 2) AS a, sum(n * p1 * (1 - p1)) AS b, sum(n * (n - 1) * p1 * (1 - p1)) AS c FROM dj),
d1 AS (
  SELECT suffix, domain, (bad + k * p1) / (n + k) AS p2 FROM dj,
    (SELECT least(200, greatest(2, CASE WHEN NOT c > 0 OR c IS NULL THEN 2 WHEN (a - b) / c <= 0 THEN 200 ELSE 1 / ((a - b) / c) - 1 END)) AS k FROM kd)),
hj AS (SELECT h.*, coalesce(d1.p2, s1.p1, t.p) AS prior FROM h CROSS JOIN t LEFT JOIN d1 USING (suffix, domain) LEFT JOIN s1 USING (suffix)),
kh AS (SELECT sum((bad - n * prior) ** 2) AS a, sum(n * prior * (1 - prior)) AS b, sum(n * (n - 1) * prior * (1 - prior)) AS c FROM hj WHERE n > 0),
hp AS (
  SELECT host, (bad + k * prior) / (n + k) AS mean, n + k AS w FROM hj,
    (SELECT least(200, greatest(2, CASE WHEN NOT c > 0 OR c IS NULL THEN 2 WHEN (a - b) / c <= 0 THEN 200 ELSE 1 / ((a - b) / c) - 1 END)) AS k FROM kh)),
bad AS (SELECT host FROM hp WHERE mean - 1.645 * sqrt(mean * (1 - mean) / (w + 1)) > 0.5)
SELECT p.page_id, p.host, p.path, fit.rule,
  coalesce(fit.verdict, CASE WHEN bad.host IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN fit USING (page_id) LEFT JOIN bad ON bad.host = p.host
"""
