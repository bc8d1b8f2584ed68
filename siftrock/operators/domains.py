"""Domains of sets of files, such as repositories, by four routes: names of files, texts in manifests, names of sources, patterns in a sample of sources.

Rules are a bounded registry. Names and manifests are met in one Arrow pass over all files; folders are asked once and their answers kept, as
files share them. Patterns are looked for in the first files of each detected language only. What is shuffled are hits.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from siftrock.functions.text import glob_regex
from siftrock.operators.classify import LANGUAGES, first_files, language_of, languages
from siftrock.operators.matching import Texts

PREVIEW, MANIFEST_PREVIEW, SAMPLE, SHOWN = 65536, 131072, 200, 10  # the rules' own limits


@dataclass(frozen=True)
class Domain:
    """A domain holds with any hit, or ``least`` files with hits of its patterns. ``languages``: one of these must be detected, and only their files are sampled."""

    name: str
    manifests: tuple[str, ...] = ()
    texts: tuple[str, ...] = ()
    globs: tuple[str, ...] = ()
    patterns: tuple[str, ...] = ()
    languages: tuple[str, ...] = ()
    least: int = 0


# ---- fixed values

DOMAINS = (
    Domain(
        "graphql",
        texts=("graphql", "@apollo/server", "@apollo/client", "ariadne", "strawberry-graphql", "graphql-tag", "graphene", "gqlgen"),
        globs=("**/*.graphql", "**/*.gql"),
        patterns=(r"\btype\s+Query\b", r"\bextend\s+type\s+Query\b", r"\bResolver\b"),
    ),
    Domain(
        "jwt",
        texts=("jsonwebtoken", "pyjwt", "python-jose", "@nestjs/jwt", "fastapi-jwt-auth", "jose", "jwt-decode", "ruby-jwt", "go-jwt", "jose4j"),
        patterns=(r"\bjwt\.(sign|verify|decode)\b", r"\bjwt\.encode\b", r"\bRS256\b", r"\bHS256\b"),
    ),
    Domain("docker", manifests=("Dockerfile", "Containerfile", "Dockerfile.*", "docker-compose.yml", "docker-compose.yaml", "compose.yml", "compose.yaml")),
    Domain(
        "sql_migrations",
        manifests=(
            "alembic.ini", "schema.prisma", "**/migrations/**/*.sql", "**/migrations/**/*.py", "**/migrations/env.py", "**/migrations/versions/**",
            "**/db/migrate/**", "**/priv/repo/migrations/**", "**/*.sql",
        ),
        texts=("sqlalchemy", "alembic", "prisma", "drizzle-orm", "knex", "django>="),
    ),
    Domain(
        "frontend",
        texts=('"react"', '"vue"', '"svelte"', "@angular/core", "@solidjs/start", "qwik", "next", "nuxt", "remix", "preact", "astro", '"vite"'),
        globs=("**/*.tsx", "**/*.jsx", "**/*.vue", "**/*.svelte", "**/*.astro"),
    ),
    Domain(
        "mcp_server",
        texts=("@modelcontextprotocol/sdk", "modelcontextprotocol", "mcp-server", "fastmcp", "mcp[cli]"),
        patterns=(r"@mcp\.tool\b", r"from\s+mcp\b", r"\bMcpServer\b", r"\bFastMCP\b"),
    ),
    Domain("multi_tenant", patterns=(r"\btenant_id\b", r"\borg_id\b", r"\borganization_id\b", r"\bworkspace_id\b", r"\baccount_id\b"), least=3),
    Domain(
        "prompt_templates",
        texts=("openai", "anthropic", "langchain", "llamaindex", "litellm", "@ai-sdk", "vercel-ai", "cohere", "google-generativeai"),
        patterns=(r"\bChatCompletion\b", r"\bclient\.messages\.create\b", r"\bsystem_prompt\b", r"\bPromptTemplate\b", r"\binvoke_model\b"),
    ),
    Domain(
        "rest_api",
        texts=("fastapi", "flask", '"express"', "@nestjs/core", "django", "sinatra", "gin-gonic", "echo", "fiber", "starlette", "hono", "sanic"),
        patterns=(r"@app\.(?:route|get|post|put|delete|patch)\b", r"@router\.(?:get|post|put|delete|patch)\b", r"\bapp\.(?:get|post|put|delete|patch)\s*\("),
    ),
    Domain(
        "ios_native",
        manifests=("**/*.xcodeproj", "**/*.xcworkspace", "Package.swift"),
        globs=("**/*.swift",),
        patterns=(r"\bimport\s+SwiftUI\b", r"\bimport\s+UIKit\b", r"\bimport\s+CryptoKit\b"),
        languages=("swift",),
    ),
    Domain("elixir_phoenix", texts=(":phoenix,", ":phoenix_live_view,", "{:phoenix,"), globs=("**/*.eex", "**/*.heex", "**/*_web/**", "**/lib/*_web/**"), languages=("elixir",)),
    Domain("solidity_contracts", globs=("**/*.sol",), languages=("solidity",)),
    Domain(
        "i18n",
        texts=("react-intl", "next-intl", "i18next", "vue-i18n", "gettext"),
        globs=("**/locale/**/*.po", "**/locales/**/*.json", "**/i18n/**/*.json", "**/translations/**", "**/messages/**/*.po"),
    ),
    Domain(
        "l10n",
        texts=("formatjs", "@formatjs", "icu-messageformat", "globalize", "luxon"),
        patterns=(r"\bIntl\.NumberFormat\b", r"\bIntl\.DateTimeFormat\b", r"\bbabel-plugin-formatjs\b"),
    ),
    Domain("monorepo", manifests=("pnpm-workspace.yaml", "lerna.json", "nx.json", "turbo.json", "rush.json"), texts=('"workspaces"', "[workspace]")),
    Domain(
        "logging_framework",
        texts=("structlog", "loguru", '"winston"', '"pino"', "log4j", "logback", "zap", "zerolog", "slog", "log/log", "tracing"),
        patterns=(r"\bimport\s+logging\b", r"\blogger\s*=\s*logging\.getLogger\b"),
    ),
)
#: Specialists and the domains of which any calls them.
GATES = {
    "multi_tenant_detector": ("multi_tenant",),
    "graphql_reviewer": ("graphql",),
    "jwt_reviewer": ("jwt",),
    "api_design_reviewer": ("rest_api", "graphql"),
    "docker_reviewer": ("docker",),
    "prompt_injection_reviewer": ("prompt_templates",),
    "frontend_reviewer": ("frontend",),
    "ios_reviewer": ("ios_native",),
    "elixir_reviewer": ("elixir_phoenix",),
    "solidity_reviewer": ("solidity_contracts",),
    "mcp_server_reviewer": ("mcp_server",),
    "i18n_reviewer": ("i18n",),
    "l10n_reviewer": ("l10n",),
    "monorepo_reviewer": ("monorepo",),
    "logging_reviewer": ("logging_framework",),
}

MANIFESTS = tuple(sorted({m for _, names in LANGUAGES.values() for m in names}))
NAMES, TEXTS, SOURCES, PATTERNS = range(4)  # the routes, in the order of their evidence


def by_name(glob: str) -> str | None:
    """What a glob asks of a single name, that of the file or of any folder above it; none if it asks for a path."""
    bare = glob.removeprefix("**/").removeprefix("/")
    return None if "/" in bare or "**" in bare else bare


def name_regex(bare: str) -> str:
    """A name's pattern, in which only ``*`` stands for others."""
    return "^" + ".*".join(map(re.escape, bare.split("*"))) + "$"


class Folders:
    """The numbers of the globs that a path, or a folder above it, meets."""

    def __init__(self, globs: Sequence[str]):
        bare = [by_name(g) for g in globs]
        self.names = [(k, re.compile(name_regex(b))) for k, b in enumerate(bare) if b is not None]
        self.paths = [(k, re.compile(glob_regex(g))) for k, (g, b) in enumerate(zip(globs, bare)) if b is None]
        self.name, self.folder = lru_cache(maxsize=65536)(self._name), lru_cache(maxsize=65536)(self.of)

    def _name(self, name: str) -> frozenset[int]:
        return frozenset(k for k, p in self.names if p.match(name))

    def of(self, path: str) -> frozenset[int]:
        above, _, name = path.rpartition("/")
        own = self._name(name) if len(name) > 64 else self.name(name)
        own |= {k for k, p in self.paths if p.match(path)}
        return own | self.folder(above) if above else own


def _route_hits(files: DataFrame, domains: Sequence[Domain], by: Sequence[str]) -> DataFrame:
    """by, path, domain (its number), route, text of the three routes that every file is asked."""
    manifest = F.substring_index("path", "/", -1).isin(*MANIFESTS)
    rows = files.select(*by, "path", F.when(manifest, F.lower(F.substring("content", 1, MANIFEST_PREVIEW))).alias("content"))
    globs = [(d, route, g) for d, x in enumerate(domains) for route, some in ((NAMES, x.manifests), (SOURCES, x.globs)) for g in some]
    asked = [(d, t) for d, x in enumerate(domains) for t in x.texts]

    def run(batches):
        paths, texts = Folders([g for _, _, g in globs]), Texts([(t.lower(),) for _, t in asked])
        for batch in batches:
            at, out = [], []
            for i, (path, text) in enumerate(zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True)):
                hits = [(d, route, ("manifest-path: " if route == NAMES else "file: ") + path) for d, route in sorted({globs[k][:2] for k in paths.of(path)})]
                first = {}  # of a domain's texts the earliest in its list
                for k in texts.of(range(len(asked)), text) if text else ():
                    first.setdefault(asked[k][0], asked[k][1])
                hits += [(d, TEXTS, f"manifest-dep: {path} contains '{t}'") for d, t in first.items()]
                at += [i] * len(hits)
                out += hits
            yield _hits(batch, by, at, out)

    return rows.mapInArrow(run, _schema(rows, by))


def _hits(batch: pa.RecordBatch, by: Sequence[str], at: list[int], out: list[tuple]) -> pa.RecordBatch:
    kept = batch.select([*by, "path"]).take(pa.array(at, pa.int64()))
    d, route, text = zip(*out) if out else ((), (), ())
    return pa.RecordBatch.from_arrays([*kept.columns, pa.array(d, pa.int32()), pa.array(route, pa.int32()), pa.array(text, pa.string())], [*by, "path", "domain", "route", "text"])


def _schema(rows: DataFrame, by: Sequence[str]) -> StructType:
    return StructType([*rows.select(*by).schema.fields, StructField("path", StringType()), StructField("domain", IntegerType()), StructField("route", IntegerType()), StructField("text", StringType())])


def _source_hits(files: DataFrame, spoken: DataFrame, domains: Sequence[Domain], by: Sequence[str]) -> DataFrame:
    """The fourth route: the first pattern of each domain that matches, in the first files of each detected language."""
    sample = first_files(files.withColumn("lang", language_of(F.col("path"))).where("lang IS NOT NULL"), [*by, "lang"], F.split("path", "/"), SAMPLE)
    sample = sample.join(spoken.where("detected").select(*by, "lang"), [*by, "lang"], "left_semi").select(*by, "path", "lang", F.substring("content", 1, PREVIEW).alias("content"))

    def run(batches):
        patterns = [(d, x.languages, [re.compile(p) for p in x.patterns]) for d, x in enumerate(domains) if x.patterns]
        for batch in batches:
            at, out = [], []
            for i, (path, lang, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("path", "lang", "content")), strict=True)):
                for d, only, some in patterns:
                    hit = next((m for p in some if (m := p.search(text or ""))), None) if not only or lang in only else None
                    if hit is not None:
                        at.append(i)
                        out.append((d, PATTERNS, f"src: {path} :: {hit[0]}"))
            yield _hits(batch, by, at, out)

    return sample.mapInArrow(run, _schema(sample, by))


def detect(files: DataFrame, domains: Sequence[Domain] = DOMAINS, *, by: Sequence[str] = ()) -> DataFrame:
    """by, domain, detected, evidence: a row for every domain and every set of files of which there is one.

    Evidence is in the order of the routes; of each but the manifests' texts the first ten paths are shown.
    """
    files = files.select(*by, F.col("path").cast("string").alias("path"), F.col("content").cast("string").alias("content")).where("path IS NOT NULL")
    spoken = languages(files, by=by)
    hits = _route_hits(files, domains, by).unionByName(_source_hits(files, spoken, domains, by))
    shown = Window.partitionBy(*by, "domain", "route").orderBy("path")
    hits = hits.withColumn("place", F.dense_rank().over(shown)).where((F.col("route") == TEXTS) | (F.col("place") <= SHOWN))
    order = F.when(F.col("route") == TEXTS, F.split("path", "/")).otherwise(F.array("path"))
    said = F.array_sort(F.collect_list(F.struct("route", order.alias("order"), "text")))
    hits = hits.groupBy(*by, "domain").agg(F.array_distinct(F.transform(said, lambda x: x["text"])).alias("evidence"), F.size(F.collect_set(F.when(F.col("route") == PATTERNS, F.col("path")))).alias("sources"))
    numbers = F.explode(F.sequence(F.lit(0), F.lit(len(domains) - 1))).alias("domain")
    sets = files.select(*by).distinct() if by else files.groupBy().agg(F.count(F.lit(1)).alias("_n")).drop("_n")
    known = spoken.where("detected").groupBy(*by).agg(F.collect_set("lang").alias("langs"))
    every = sets.join(known, [*by], "left") if by else sets.join(F.broadcast(known))
    every = every.select(*by, F.coalesce("langs", F.array().cast("array<string>")).alias("langs"), numbers).join(hits, [*by, "domain"], "left")
    info = F.get(F.array(*[F.struct(F.lit(x.name).alias("name"), F.array(*map(F.lit, x.languages)).cast("array<string>").alias("languages"), F.lit(x.least).alias("least")) for x in domains]), F.col("domain"))
    may = (F.size(info["languages"]) == 0) | F.arrays_overlap(info["languages"], "langs")
    evidence = F.when(may & F.col("evidence").isNotNull(), F.col("evidence")).otherwise(F.array().cast("array<string>"))
    detected = F.when(info["least"] > 0, may & (F.coalesce("sources", F.lit(0)) >= info["least"])).otherwise(F.size(evidence) > 0)
    return every.select(*by, info["name"].alias("domain"), detected.alias("detected"), evidence.alias("evidence"))


def called(found: DataFrame, gates: dict[str, Sequence[str]] = GATES, *, by: Sequence[str] = ()) -> DataFrame:
    """by, specialist, fires: whether any of a specialist's domains was detected."""
    hit = [F.max(F.col("detected") & F.col("domain").isin(*some)).alias(s) for s, some in gates.items()]
    wide = found.groupBy(*by).agg(*hit)
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("specialist"), F.col(s).alias("fires")) for s in gates])).alias("x")
    return wide.select(*by, each).select(*by, "x.*")
