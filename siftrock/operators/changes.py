"""Changed code: the public types that a unified diff declares, and what should have changed with it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftrock.functions.text import first_match, line_array
from siftrock.operators.rules import banners

# ---- fixed values: declarations at the start of a line, by suffix; the first that fits counts

DECLARATIONS = {
    ("python", r"\.pyi?$"): (
        ("typeddict", r"^class\s+([A-Z]\w*)\s*\([^)]*TypedDict[^)]*\)\s*:"),
        ("protocol", r"^class\s+([A-Z]\w*)\s*\([^)]*Protocol[^)]*\)\s*:"),
        ("namedtuple", r"^class\s+([A-Z]\w*)\s*\([^)]*NamedTuple[^)]*\)\s*:"),
        ("enum", r"^class\s+([A-Z]\w*)\s*\([^)]*(?:Enum|Flag)[^)]*\)\s*:"),
        ("class", r"^class\s+([A-Z]\w*)\s*[(:]"),
    ),
    ("typescript", r"\.(?:tsx?|mts|cts)$"): (
        ("interface", r"^export\s+(?:default\s+)?interface\s+([A-Z]\w*)\b"),
        ("type", r"^export\s+(?:default\s+)?type\s+([A-Z]\w*)\s*="),
        ("enum", r"^export\s+(?:default\s+)?enum\s+([A-Z]\w*)\b"),
        ("class", r"^export\s+(?:default\s+)?(?:abstract\s+)?class\s+([A-Z]\w*)\b"),
    ),
    ("go", r"\.go$"): (("struct", r"^type\s+([A-Z]\w*)\s+struct\s*\{"), ("interface", r"^type\s+([A-Z]\w*)\s+interface\s*\{")),
    ("rust", r"\.rs$"): (("struct", r"^pub\s+struct\s+([A-Z]\w*)\b"), ("enum", r"^pub\s+enum\s+([A-Z]\w*)\b"), ("trait", r"^pub\s+trait\s+([A-Z]\w*)\b")),
}
SCHEMAS = r"(?i)(?:\.proto|\.graphql|\.gql|(?:^|[/.])openapi\.(?:ya?ml|json)|/schema\.json|\.tsp)$"
PIPELINES = r"^(?:\.github/workflows/|\.gitlab-ci\.yml$|\.circleci/|azure-pipelines\.yml$|Jenkinsfile$)"
CONTAINERS = r"(?i)(?:^|/)(?:Dockerfile(?:\.[\w\-.]+)?$|Containerfile$|(?:docker-compose(?:\.[\w\-.]+)?|compose)\.ya?ml$)"
NOTES = r"(?i)(?:^|/)(?:README|docs/.+\.(?:rst|mdx)|CHANGELOG)$|\.md$"


def new_types(diffs: DataFrame) -> DataFrame:
    """diff_id, file, line, kind, name, language of the types that ``diffs`` (diff_id, content) add at the top of a module.

    A diff is cut into files and those into hunks by expressions: a line's number is its hunk's start plus its place
    among the lines that are kept, so nothing is folded or shuffled. A class right below an added ``@dataclass`` is one.
    """
    part = diffs.select("diff_id", F.explode(F.split("content", r"(?m)^(?=\+\+\+ )")).alias("part")).where(F.col("part").startswith("+++ "))
    name = F.regexp_extract("part", r"^\+\+\+ ([^\t\r\n]*)", 1)
    part = part.withColumn("file", F.regexp_replace(F.trim(name), "^b/", "")).where("file != '/dev/null'")
    hunk = part.select("diff_id", "file", F.explode(F.split("part", r"(?m)^(?=@@ )")).alias("hunk")).where(F.col("hunk").startswith("@@ "))
    start = F.regexp_extract("hunk", r"^@@ -\d+(?:,\d+)? \+(\d+)", 1).try_cast("int")
    hunk = hunk.select("diff_id", "file", start.alias("first"), line_array(F.col("hunk")).alias("raw"))
    both = F.transform("raw", lambda x, i: F.struct(x.alias("x"), F.when(i > 0, F.get("raw", i - 1)).alias("above")))
    kept = F.filter(both, lambda r: r.x.rlike(r"^[ +]"))
    line = hunk.select("diff_id", "file", "first", F.posexplode(kept).alias("place", "r")).where(F.col("r.x").startswith("+"))
    line = line.select("diff_id", "file", (F.col("first") + F.col("place")).alias("line"), F.substring("r.x", 2, 1 << 30).alias("code"), F.coalesce(F.col("r.above").rlike(r"^\+@dataclass\b"), F.lit(False)).alias("data"))
    held = [
        F.when(F.lower("file").rlike(suffix) & F.col("code").rlike(p), F.struct(F.lit(kind).alias("kind"), first_match(F.col("code"), p, 1).alias("name"), F.lit(language).alias("language")))
        for (language, suffix), some in DECLARATIONS.items()
        for kind, p in some
    ]
    out = line.withColumn("d", F.coalesce(*held)).where("d IS NOT NULL")
    kind = F.when((F.col("d.kind") == "class") & (F.col("d.language") == "python") & F.col("data"), "dataclass").otherwise(F.col("d.kind"))
    return out.select("diff_id", "file", "line", kind.alias("kind"), "d.name", "d.language")


def unaccompanied(files: DataFrame) -> DataFrame:
    """Schemas of a change without any generated file, pipelines and containers of one without any notes.

    What a file needs and the set lacks is an anti-join against at most two rows; files are judged where they lie."""
    path = F.col("path").cast("string")
    needs = (("SCHEMA_NO_CODEGEN", "warning", SCHEMAS, "made"), ("CI_NO_NOTES", "nit", PIPELINES, "told"), ("DOCKERFILE_NO_NOTES", "nit", CONTAINERS, "told"))
    held = [F.when(path.rlike(p), F.struct(F.lit(c).alias("code"), F.lit(s).alias("severity"), F.lit(n).alias("need"))) for c, s, p, n in needs]
    rows = files.select(path.alias("path"), F.explode(F.array_compact(F.array(*held))).alias("x")).select("path", "x.*")
    made, told = banners(files).select(F.lit("made").alias("need")), files.where(path.rlike(NOTES)).select(F.lit("told").alias("need"))
    out = rows.join(made.unionByName(told).distinct(), "need", "left_anti")
    return out.select("path", F.lit(1).alias("line"), "severity", F.lit("operational").alias("category"), "code", F.col("path").alias("message"))
