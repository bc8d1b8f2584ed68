"""Queries of the registries of software types and domains. Repositories are made from rows of ``part``: which types and domains are planted in each, in which
of their ways and with which gaps, are its columns. The SQL holds the files against the registries by itself, with patterns and lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftrock.functions.batches import spread
from siftrock.functions.text import glob_regex
from siftrock.operators import classify, domains, scenarios, software
from siftrock.sources.tables import table

#: A text that each pattern of the registries matches.
MATCHED = {
    r"^\s*void\s+\w+\s*\(": "void f (", r"^\s*int\s+\w+\s*\(": "int main(", r"def\s+parse_\w+": "def parse_it", r"def\s+tokenize_\w+": "def  tokenize_x", r"fn\s+parse_\w+": "fn parse_a",
    r"fn\s+tokenize_\w+": "fn tokenize_b", r"\w+_parse\s*\(": "my_parse (", r"\w+_tokenize\s*\(": "my_tokenize(",
}


def path_of(glob: str) -> str:
    """A path that meets a glob."""
    return glob.replace("/**/", "/m/n/").replace("**/", "a/b/", 1 if glob.startswith("**/") else 0).replace("/**", "/y/z").replace("*", "x")


def _text(t: str) -> str:
    return MATCHED[t[3:]] if t.startswith("re:") else t


def type_slots() -> list[tuple]:
    """(type, slot, path, texts): the files that a fingerprint asks for, each with the texts of which one will do."""
    out = []
    for i, f in enumerate(software.FINGERPRINTS):
        asked = [(g, ("",)) for g in f.globs] + list(f.holds) + [(g, ("",)) for g in f.hint_globs] + list(f.hints)
        out += [(i, j, path_of(g), [_text(t) for t in texts]) for j, (g, texts) in enumerate(asked)]
    return out


def domain_slots() -> list[tuple]:
    """(domain, slot, path, texts) of each route of a domain."""
    out = []
    for i, x in enumerate(domains.DOMAINS):
        shown = {r"\btype\s+Query\b": "type  Query", r"\bjwt\.(sign|verify|decode)\b": "jwt.verify"}
        plain = [shown.get(p, _plain(p)) for p in x.patterns]
        src = {"swift": "s/v.swift"}.get((x.languages or ("",))[0], "s/v.go")
        asked = [(path_of(g), [""]) for g in (*x.manifests, *x.globs)] + ([("p/Cargo.toml", [t.upper() for t in x.texts])] if x.texts else []) + [(src if k == 0 else f"s/{k}{src[3:]}", [t]) for k, t in enumerate(plain)]
        asked += [({"swift": "Package.swift", "elixir": "mix.exs", "solidity": "c/foundry.toml"}[lang], ["x"]) for lang in x.languages] or [("go.mod", ["x"])]
        out += [(i, j, p, t) for j, (p, t) in enumerate(asked)]
    return out


def _plain(pattern: str) -> str:
    import re

    return re.sub(r"\(\?:(\w+)[^)]*\)", r"\1", pattern).replace(r"\b", "").replace(r"\s+", " ").replace(r"\s*", "").replace("\\", "")


def repositories(spark, d, slots: list[tuple], kinds: int) -> DataFrame:
    """repo, path, content: for each part the files of two kinds, but for one slot in some."""
    s = spark.createDataFrame(slots, "i int, j int, path string, texts array<string>")
    p = spread(table(spark, d, "part")).select(F.col("p_partkey").alias("repo"), "p_size", F.explode(F.array((F.col("p_partkey") % kinds).cast("int"), F.col("p_size") % kinds)).alias("i"))
    rows = p.join(F.broadcast(s), "i").where("(repo + j) % 5 > 0")  # the registry's slots, a few hundred rows whatever the data
    return rows.select("repo", "path", F.get("texts", ((F.col("p_size") + F.col("j")) % F.size("texts")).cast("int")).alias("content"))


def software_types(spark, d):
    files = repositories(spark, d, type_slots(), len(software.FINGERPRINTS))
    return software.detected_types(files, by=["repo"]).withColumn("evidence", F.array_join("evidence", "; "))


def repository_languages(spark, d):
    files = repositories(spark, d, domain_slots(), len(domains.DOMAINS))
    return classify.languages(files, least=3, by=["repo"]).withColumn("evidence", F.array_join("evidence", "; "))


def repository_domains(spark, d):
    files = repositories(spark, d, domain_slots(), len(domains.DOMAINS))
    return domains.detect(files, by=["repo"]).withColumn("evidence", F.array_join("evidence", "; "))


def specialists(spark, d):
    return domains.called(domains.detect(repositories(spark, d, domain_slots(), len(domains.DOMAINS)), by=["repo"]), by=["repo"])


KINDS = [*(kind for kind, _, _ in scenarios.LABELS), "library_export"]


def scenario_families(spark, d):
    """The families of the type of every part, as pairs; a part's type is its number's."""
    types = spark.createDataFrame(list(enumerate(scenarios.TYPES)), "i int, type string")
    own = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % len(scenarios.TYPES)).cast("int").alias("i"))
    return own.join(F.broadcast(types), "i").join(F.broadcast(scenarios.bridge(spark)), "type").select("p_partkey", "type", "family")


def scenario_expansion(spark, d):
    """Scenarios of entry points made of parts, a repository for each brand: types, kinds, places, metadata and documentation are columns."""
    get = lambda some, i: F.get(F.array(*map(F.lit, some)), i)
    key, size = F.col("p_partkey").cast("int"), F.col("p_size")
    entries = [F.struct(F.lit(k).alias("k"), F.concat(F.lit(f"{k} "), "p_name").alias("v")) for k in ("method", "path", "command", "vector", "cmd")]
    entries = F.filter(F.array(*[F.when((size + i) % 3 > 0, x) for i, x in enumerate(entries)]), lambda x: x.isNotNull())
    points = table(spark, d, "part").select(
        "p_brand", get(scenarios.TYPES, key % len(scenarios.TYPES)).alias("type_origin"), get(KINDS, size % len(KINDS)).alias("kind"),
        F.concat(F.lit("src/"), "p_type").alias("file"), (size % 9).alias("line"), "p_name", F.when(size % 4 == 0, F.concat(F.lit("  "), "p_type", F.lit("\n"))).alias("docstring"),
        F.map_from_entries(entries).alias("metadata"),
    ).withColumnRenamed("p_name", "symbol")
    out = scenarios.scenarios(points, by=["p_brand"])
    modes = F.array_join("failure_modes_to_test", ",").alias("modes")
    return out.select("p_brand", "id", "type_origin", "family", "title", "entry_point.file", "entry_point.line", "entry_point.symbol", "actor_role", F.col("stimulus.kind").alias("stimulus"), "intended_behaviour", modes)


def queries() -> dict:
    return {f.__name__: f for f in (scenario_families, scenario_expansion, software_types, repository_languages, repository_domains, specialists)}


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(texts) -> str:
    return "[" + ", ".join(map(_q, texts)) + "]::VARCHAR[]"


def _files(slots: list[tuple], kinds: int) -> str:
    values = ", ".join(f"({i}, {j}, {_q(p)}, {_list(t)})" for i, j, p, t in slots)
    return f"""slots(i, j, path, texts) AS (VALUES {values}),
p AS (SELECT p_partkey AS repo, p_size, unnest([p_partkey % {kinds}, p_size % {kinds}]) AS i FROM part),
files AS (SELECT repo, path, texts[1 + (p_size + j) % len(texts)] AS content FROM p JOIN slots USING (i) WHERE (repo + j) % 5 > 0)"""


def _types_sql() -> str:
    prints = software.FINGERPRINTS
    checks = software.checks_of(prints)
    number = {c: k for k, c in enumerate(checks)}
    values = ", ".join(f"({k}, {_q(glob_regex(g))}, {_list(t)})" for k, (g, t) in enumerate(checks))
    has = lambda c: f"list_contains(ks, {number[c]})"
    seen, cases = set(), []
    for f in prints:
        every = [has(c) for c in f.holds] + (["(" + " OR ".join(has((g, ())) for g in f.globs) + ")"] if f.globs else []) + [f"NOT is_{u}" for u in f.unless if u in seen]
        cases.append(f"{' AND '.join(every)} AS is_{f.name}")
        seen.add(f.name)
    rows = []
    for f in prints:
        hints = [(g, ()) for g in f.hint_globs] + list(f.hints)
        said = ", ".join(f"CASE WHEN {has(c)} THEN {_q(c[0] + ': ')} || firsts[{number[c]}] END" for c in [(g, ()) for g in f.globs] + list(f.holds) + hints)
        n = " + ".join([f"{has(c)}::INT" for c in hints] or ["0"])
        rows.append(f"SELECT repo, '{f.name}' AS type, round(least(0.98, 0.85 + 0.04 * ({n})), 3)::DOUBLE AS confidence, array_to_string(list_filter([{said}], lambda x: x IS NOT NULL), '; ') AS evidence FROM h WHERE is_{f.name}")
    return f"""WITH {_files(type_slots(), len(prints))},
checks(k, path_like, any_of) AS (VALUES {values}),
met AS (SELECT repo, k, array_to_string(min(string_split(path, '/')), '/') AS path FROM files JOIN checks ON regexp_matches(path, path_like)
  AND (len(any_of) = 0 OR len(list_filter(any_of, lambda t: CASE WHEN t[1:3] = 're:' THEN regexp_matches(content, t[4:]) ELSE contains(content, t) END)) > 0) GROUP BY 1, 2),
m AS (SELECT repo, list(k) AS ks, map(list(k), list(path)) AS firsts FROM met GROUP BY 1),
every AS (SELECT repo, coalesce(ks, []) AS ks, firsts FROM (SELECT DISTINCT repo FROM files) LEFT JOIN m USING (repo)),
h AS (SELECT *, {", ".join(cases)} FROM every),
t AS ({" UNION ALL ".join(rows)})
SELECT * FROM t UNION ALL SELECT repo, 'unknown_software', 0.85::DOUBLE, '' FROM every WHERE repo NOT IN (SELECT repo FROM t)"""


def _spoken(least: int) -> str:
    ext = ", ".join(f"('{lang}', '{e}')" for lang, (some, _) in classify.LANGUAGES.items() for e in some)
    man = ", ".join(f"('{lang}', '{m}', {m in classify.PROOFS.get(lang, names)})" for lang, (_, names) in classify.LANGUAGES.items() for m in names)
    return f"""ext(lang, suffix) AS (VALUES {ext}), man(lang, name, proof) AS (VALUES {man}),
f AS (SELECT *, string_split(path, '/')[-1] AS name, lower(regexp_extract(path, '[^/](\\.[^./]+)$', 1)) AS suffix FROM files),
s AS (SELECT repo, lang, false AS manifest, suffix AS said, count(*) AS n, false AS proof FROM f JOIN ext USING (suffix) GROUP BY 1, 2, 4
  UNION ALL SELECT repo, lang, true, f.name, count(*), bool_or(proof) FROM f JOIN man ON man.name = f.name GROUP BY 1, 2, 4),
l AS (SELECT repo, lang, coalesce(sum(n) FILTER (NOT manifest), 0)::BIGINT AS files, coalesce(sum(n) FILTER (manifest), 0)::BIGINT AS manifests,
    coalesce(bool_or(proof), false) AS proven, string_agg(CASE WHEN manifest THEN 'manifest: ' || said ELSE n || ' ' || said || CASE WHEN n = 1 THEN ' file' ELSE ' files' END END, '; ' ORDER BY manifest, said) AS evidence FROM s GROUP BY 1, 2),
spoken AS (SELECT repo, lang, files, manifests, files >= {least} OR (proven AND (files > 0 OR lang NOT IN ('javascript', 'typescript'))) AS detected, evidence FROM l)"""


def _domains_sql() -> str:
    some = domains.DOMAINS
    names = ", ".join(f"({i}, {route}, {_q(domains.name_regex(domains.by_name(g)))})" for i, x in enumerate(some) for route, gs in ((0, x.manifests), (2, x.globs)) for g in gs if domains.by_name(g) is not None)
    paths = ", ".join(f"({i}, {route}, {_q(glob_regex(g))})" for i, x in enumerate(some) for route, gs in ((0, x.manifests), (2, x.globs)) for g in gs if domains.by_name(g) is None)
    texts = ", ".join(f"({i}, {k}, {_q(t)})" for i, x in enumerate(some) for k, t in enumerate(x.texts))
    patterns = ", ".join(f"({i}, {k}, {_q(p)})" for i, x in enumerate(some) for k, p in enumerate(x.patterns))
    info = ", ".join(f"({i}, '{x.name}', {_list(x.languages)}, {x.least})" for i, x in enumerate(some))
    return f"""WITH {_files(domain_slots(), len(some))},
{_spoken(10)},
names(i, route, r) AS (VALUES {names}), paths(i, route, r) AS (VALUES {paths}), texts(i, k, t) AS (VALUES {texts}), patterns(i, k, r) AS (VALUES {patterns}), info(i, domain, langs, least) AS (VALUES {info}),
parts AS (SELECT repo, path, content, string_split(path, '/') AS ps FROM files),
above AS (SELECT *, unnest(range(1, len(ps) + 1)) AS n FROM parts),
hits AS (
  SELECT DISTINCT repo, i, route, path, CASE WHEN route = 0 THEN 'manifest-path: ' ELSE 'file: ' END || path AS text FROM above, names WHERE regexp_matches(ps[n], r)
  UNION SELECT DISTINCT repo, i, route, path, CASE WHEN route = 0 THEN 'manifest-path: ' ELSE 'file: ' END || path FROM above, paths WHERE regexp_matches(array_to_string(ps[1:n], '/'), r)
  UNION SELECT repo, i, 1, path, 'manifest-dep: ' || path || ' contains ''' || arg_min(t, k) || '''' FROM f, texts WHERE name IN (SELECT name FROM man) AND contains(lower(content), lower(t)) GROUP BY repo, i, path, content
  UNION SELECT f.repo, i, 3, path, 'src: ' || path || ' :: ' || arg_min(regexp_extract(content, r), k) FROM f JOIN ext USING (suffix) JOIN spoken ON spoken.repo = f.repo AND spoken.lang = ext.lang AND detected
    JOIN patterns ON regexp_matches(content, r) JOIN info USING (i) WHERE len(langs) = 0 OR list_contains(langs, ext.lang) GROUP BY f.repo, i, path, content),
shown AS (SELECT * FROM hits QUALIFY route = 1 OR row_number() OVER (PARTITION BY repo, i, route ORDER BY path) <= 10),
e AS (SELECT repo, i, string_agg(text, '; ' ORDER BY route, CASE WHEN route = 1 THEN string_split(path, '/') ELSE [path] END, text) AS evidence, count(*) FILTER (route = 3) AS sources FROM shown GROUP BY 1, 2),
k AS (SELECT repo, list(lang) FILTER (detected) AS known FROM spoken GROUP BY 1),
found AS (
  SELECT r.repo, domain, CASE WHEN len(langs) = 0 OR list_has_any(langs, coalesce(known, [])) THEN coalesce(evidence, '') ELSE '' END AS evidence, coalesce(sources, 0) AS sources, least
  FROM (SELECT DISTINCT repo FROM files) r CROSS JOIN info LEFT JOIN k ON k.repo = r.repo LEFT JOIN e ON e.repo = r.repo AND e.i = info.i),
d AS (SELECT repo, domain, CASE WHEN least > 0 THEN sources >= least ELSE evidence <> '' END AS detected, evidence FROM found)"""


def _bridge_sql() -> str:
    types = ", ".join(f"({i}, '{t}')" for i, t in enumerate(scenarios.TYPES))
    applies = ", ".join(f"('{f.name}', '{i}')" for f in scenarios.FAMILIES for i in f.applies)
    listed = ", ".join(f"('{g}', '{t}')" for g, some in scenarios.GROUPS.items() for t in some)
    return f"""types(i, type) AS (VALUES {types}), applies(family, item) AS (VALUES {applies}), listed(item, type) AS (VALUES {listed}),
bridge AS (SELECT DISTINCT type, family FROM applies a JOIN types t ON a.item = 'ALL' OR a.item = t.type OR EXISTS (SELECT 1 FROM listed l WHERE l.item = a.item AND l.type = t.type)
  OR (ends_with(a.item, '_*') AND starts_with(t.type, left(a.item, length(a.item) - 1)) AND a.item NOT IN (SELECT item FROM listed)))"""


def _expansion_sql() -> str:
    about = ", ".join(f"({_q(f.name)}, {_q(f.title)}, {_q(f.role)}, {_q(','.join(f.modes))})" for f in scenarios.FAMILIES)
    has = {k: f"(p_size + {i}) % 3 > 0" for i, k in enumerate(("method", "path", "command", "vector", "cmd"))}
    label = " ".join(f"WHEN kind = '{kind}' AND {' AND '.join(has[k] for k in keys)} THEN {shown}" for (kind, keys, _), shown in zip(scenarios.LABELS, ("'method ' || p_name || ' path ' || p_name", "'command ' || p_name", "'ISR vector ' || p_name || ' (' || p_name || ')'", "'syscall cmd ' || p_name || ' (' || p_name || ')'")))
    default = " || family || ".join(map(_q, scenarios.DEFAULT.split("{family}")))
    return f"""WITH {_bridge_sql()},
about(family, title, actor_role, modes) AS (VALUES {about}),
p AS (SELECT *, ({_list(KINDS)})[1 + p_size % {len(KINDS)}] AS kind, 'src/' || p_type AS file, p_size % 9 AS line, CASE WHEN p_size % 4 = 0 THEN '  ' || p_type || chr(10) END AS doc FROM part JOIN types ON i = p_partkey % {len(scenarios.TYPES)}),
q AS (SELECT *, CASE {label} ELSE p_name END AS label,
    list_sort(list_filter([{", ".join(f"CASE WHEN {h} THEN '{k} ' || p_name END" for k, h in has.items())}], lambda x: x IS NOT NULL)) AS entries FROM p),
one AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY p_brand, type, file, line, p_name ORDER BY kind, doc NULLS FIRST, entries) = 1)
SELECT p_brand, printf('SCEN-%04d', row_number() OVER (PARTITION BY p_brand ORDER BY type, file, line, p_name, family)) AS id, type AS type_origin, family, replace(title, '{{entry}}', label) AS title,
  file, line, p_name AS symbol, actor_role, family || '_default' AS stimulus, coalesce(nullif(trim(doc, ' ' || chr(10)), ''), {default}) AS intended_behaviour, modes
FROM one JOIN bridge USING (type) JOIN about USING (family)"""


def oracle_sql() -> dict[str, str]:
    gates = ", ".join(f"('{s}', {_list(some)})" for s, some in domains.GATES.items())
    kinds = len(domains.DOMAINS)
    return {
        "scenario_families": f"WITH {_bridge_sql()} SELECT p_partkey, type, family FROM part JOIN types ON i = p_partkey % {len(scenarios.TYPES)} JOIN bridge USING (type)",
        "scenario_expansion": _expansion_sql(),
        "software_types": _types_sql(),
        "repository_languages": f"WITH {_files(domain_slots(), kinds)}, {_spoken(3)} SELECT * FROM spoken",
        "repository_domains": _domains_sql() + " SELECT * FROM d",
        "specialists": _domains_sql() + f", g(specialist, gates) AS (VALUES {gates}) SELECT repo, specialist, bool_or(detected AND list_contains(gates, domain)) AS fires FROM d CROSS JOIN g GROUP BY 1, 2",
    }
