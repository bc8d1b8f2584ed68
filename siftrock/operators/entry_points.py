"""Entry points of programs: a registry of patterns, one Arrow function that finds their places, and joins by place.

Patterns that run over line ends, and the places of their matches, are beyond column expressions: ``sites`` lists all
matches of all patterns, one row each, in a single pass over the files. What follows is filters, windows and dedup.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftrock.functions.batches import gathered, texts
from siftrock.operators.joins import nearest_before

SITES = "path string, rule int, line_no int, start int, end int, symbol string"


@dataclass(frozen=True)
class Pattern:
    """Matches of ``pattern`` in files of these suffixes. ``symbol`` is filled with the pattern's named groups.

    ``comments``: blank these first, every character but line breaks by a space, so that places stay.
    """

    type: str
    kind: str
    suffixes: tuple[str, ...]
    pattern: str
    symbol: str
    comments: str | None = None


# ---- fixed values

C_COMMENTS = r"//[^\n]*|/\*[\s\S]*?\*/"
GO_PATH = r"\s*\(\s*(?P<quote>[\"`])(?P<path>[^\"`]*)(?P=quote)"
UNITY = {
    "boot_path": ("Start", "Awake", "OnEnable", "OnDisable"),
    "main_function": ("Update", "FixedUpdate", "LateUpdate"),
    "event_listener": ("OnCollisionEnter", "OnCollisionExit", "OnCollisionStay", "OnTriggerEnter", "OnTriggerExit", "OnTriggerStay", "OnMouseDown", "OnMouseUp", "OnMouseOver"),
}
UNITY_METHOD = r"(?m)^\s*(?:(?:public|private|protected|internal)\s+)*(?:(?:static|virtual|override|sealed|new)\s+)*(?:void|IEnumerator)\s+(?P<name>NAMES)\s*\([^)]*\)"
UNITY_CLASS = r"\bclass\s+(?P<name>[A-Za-z_]\w*)\s*:\s*[^{]*MonoBehaviour[^{]*\{"
SCRIPTS = (".js", ".mjs", ".cjs", ".ts", ".tsx")

PATTERNS = (
    Pattern("iac_terraform", "terraform_resource", (".tf",), r'(?m)^\s*resource\s+"(?P<type>[A-Za-z0-9_]+)"\s+"(?P<name>[A-Za-z0-9_\-]+)"\s*\{', "{type}.{name}"),
    Pattern("iac_terraform", "terraform_resource", (".tf",), r'(?m)^\s*module\s+"(?P<name>[A-Za-z0-9_\-]+)"\s*\{', "module.{name}"),
    Pattern("library_rust", "library_export", (".rs",), r'(?m)^pub\s+(?:async\s+|unsafe\s+|const\s+|extern\s+(?:"[^"]+"\s+)?)*(?:fn|struct|trait|enum)\s+(?P<name>[A-Za-z_]\w*)', "{name}"),
    Pattern("desktop_tauri", "ipc_handler", (".rs",), r"#\[\s*tauri::command\s*(?:\([^)]*\))?\s*\]\s*(?:pub\s+(?:\([^)]*\)\s+)?)?(?:async\s+)?fn\s+(?P<name>[A-Za-z_]\w*)\s*\(", "{name}"),
    Pattern("desktop_electron", "ipc_handler", SCRIPTS, r"\bipcMain\s*\.\s*(?:on|handle|once|removeAllListeners|removeHandler|removeListener)\s*\(\s*['\"](?P<name>[^'\"]+)['\"]", "{name}"),
    Pattern("desktop_electron", "boot_path", SCRIPTS, r"\bnew\s+BrowserWindow\s*\(", "BrowserWindow"),
    Pattern("desktop_electron", "boot_path", SCRIPTS, r"\bapp\s*\.\s*(?:on\s*\(\s*['\"]ready['\"]|whenReady\s*\(\s*\)\s*\.\s*then\s*\()", "app.ready"),
    Pattern("web_service_go", "http_route", (".go",), r"\b(?P<on>[A-Za-z_]\w*)\s*\.(?P<verb>GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)" + GO_PATH, "{on}.{verb} {path}", C_COMMENTS),
    Pattern("web_service_go", "http_route", (".go",), r"\b(?P<on>[A-Za-z_]\w*)\s*\.(?P<upper>Get|Post|Put|Delete|Patch|Head|Options)" + GO_PATH, "{on}.{upper} {path}", C_COMMENTS),
    Pattern("web_service_go", "http_route", (".go",), r"\b(?P<on>[A-Za-z_]\w*)\s*\.(?P<verb>HandleFunc|Handle)" + GO_PATH, "{on}.{verb} {path}", C_COMMENTS),
    Pattern("game_unity", "class", (".cs",), UNITY_CLASS, "{name}"),
    *(Pattern("game_unity", kind, (".cs",), UNITY_METHOD.replace("NAMES", "|".join(names)), "{name}") for kind, names in UNITY.items()),
)

#: For software of no known type: what starts a program and what it shows, by suffix. Of equal places the first counts.
UNKNOWN = tuple(
    Pattern("unknown_software", kind, suffixes, "(?m)" + pattern, symbol)
    for kind, suffixes, pattern, symbol in (
        ("main_function", (".py",), r"^if\s+__name__\s*==\s*['\"]__main__['\"]", "__main__"),
        ("main_function", (".py",), r"^def\s+(?P<name>main)\s*\(", "{name}"),
        ("main_function", (".js", ".ts"), r"^(?:async\s+)?function\s+(?P<name>main)\s*\(", "{name}"),
        ("main_function", (".rs",), r"^fn\s+(?P<name>main)\s*\(", "{name}"),
        ("main_function", (".go",), r"^func\s+(?P<name>main)\s*\(", "{name}"),
        ("main_function", (".c", ".cpp"), r"^int\s+(?P<name>main)\s*\(", "{name}"),
        ("main_function", (".cs",), r"static\s+(?:async\s+)?(?:Task|void|int)\s+(?P<name>Main)\s*\(", "{name}"),
        ("main_function", (".rb",), r"^(?:if|unless)\s+__FILE__\s*==\s*\$PROGRAM_NAME", "__main__"),
        ("main_function", (".java",), r"public\s+static\s+void\s+(?P<name>main)\s*\(", "{name}"),
        ("main_function", (".kt",), r"^fun\s+(?P<name>main)\s*\(", "{name}"),
        ("main_function", (".swift",), r"@main", "__main__"),
        ("library_export", (".py",), r"^def\s+(?P<name>[a-z][a-zA-Z0-9_]*)\s*\(", "{name}"),
        ("library_export", (".js", ".ts"), r"^export\s+(?:async\s+)?function\s+(?P<name>[a-zA-Z][a-zA-Z0-9_]*)\s*\(", "{name}"),
        ("library_export", (".rs",), r"^pub\s+fn\s+(?P<name>[a-z][a-zA-Z0-9_]*)\s*[<(]", "{name}"),
        ("library_export", (".go",), r"^func\s+(?P<name>[A-Z][a-zA-Z0-9_]*)\s*\(", "{name}"),
    )
)


# ---- places


def _filled(symbol: str, match: re.Match) -> str:
    return symbol.format(**{k: (v or "").upper() if k == "upper" else v or "" for k, v in match.groupdict().items()})


def _places(text: str, path: str, patterns: Sequence[Pattern]):
    """(rule, line, start, end, symbol) of every match; lines end at line feeds."""
    ends = [m.start() for m in re.finditer("\n", text)]
    for k, p in enumerate(patterns):
        if not p.suffixes or path.lower().endswith(p.suffixes):
            seen = re.sub(p.comments, lambda m: re.sub(r"[^\n]", " ", m[0]), text) if p.comments else text
            for m in re.finditer(p.pattern, seen):
                yield k, bisect_left(ends, m.start()) + 1, m.start(), m.end(), _filled(p.symbol, m)


def sites(files: DataFrame, patterns: Sequence[Pattern]) -> DataFrame:
    """Every match of every pattern: path, rule (its number), line_no, start, end, symbol. Null and empty texts have none."""
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string())
    names = ["path", "rule", "line_no", "start", "end", "symbol"]

    def run(batches):
        return gathered(((path, *r) for path, text in texts(batches) for r in _places(text or "", path or "", patterns)), kinds, names)

    suffixes = {s for p in patterns for s in p.suffixes}
    if suffixes and all(p.suffixes for p in patterns):
        files = files.where(F.lower(F.col("path").cast("string")).rlike("(?:" + "|".join(re.escape(s) for s in sorted(suffixes)) + ")$"))
    return files.select(F.col("path").cast("string").alias("path"), "content").mapInArrow(run, SITES)


def _described(found: DataFrame, patterns: Sequence[Pattern]) -> DataFrame:
    info = F.array(*[F.struct(F.lit(p.type).alias("type_origin"), F.lit(p.kind).alias("kind")) for p in patterns])
    return found.withColumn("_i", F.get(info, F.col("rule"))).select("*", "_i.type_origin", "_i.kind").drop("_i")


def _first_of_each(found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of equal keys the row of the earliest rule; a minimum, so that equal rows merge before they are shuffled."""
    rest = [c for c in ("type_origin", "kind", "path", "line_no", "symbol") if c not in keys]
    best = found.groupBy(*keys).agg(F.min(F.struct("rule", *rest)).alias("_b"))
    return best.select(*keys, *[F.col(f"_b.{c}").alias(c) for c in rest]).select("type_origin", "kind", "path", F.col("line_no").alias("line"), "symbol")


def discover(files: DataFrame) -> DataFrame:
    """type_origin, kind, path, line, symbol of the known types' entry points, once each.

    A callback of a game's script belongs to the nearest class above it in its file that is a behaviour; without one it
    is dropped."""
    found = _described(sites(files, PATTERNS), PATTERNS)
    plain = found.where("type_origin != 'game_unity'")
    is_class = F.col("kind") == "class"
    placed = found.where("type_origin = 'game_unity'").withColumn("at", F.when(is_class, F.col("end") - 1).otherwise(F.col("start")))
    owned = nearest_before(placed, ["path"], ["at"], is_class, F.col("symbol"), "owner").where(~is_class & F.col("owner").isNotNull())
    owned = owned.withColumn("symbol", F.concat_ws(".", "owner", "symbol")).select(plain.columns)
    return _first_of_each(plain.unionByName(owned), ["type_origin", "path", "line_no", "symbol", "kind"])


def discover_unknown(files: DataFrame, *, most: int = 32768) -> DataFrame:
    """Entry points of software of no known type, from the first ``most`` characters of a file (the operator's contract)."""
    head = files.withColumn("content", F.substring("content", 1, most))
    return _first_of_each(_described(sites(head, UNKNOWN), UNKNOWN), ["path", "line_no", "symbol"])


def ranked(points: DataFrame) -> DataFrame:
    """Entry points with their place in the order of file, line and symbol, by type. A type's rows meet in one task."""
    w = Window.partitionBy("type_origin").orderBy("path", "line", "symbol", "kind")
    return points.withColumn("rank", F.row_number().over(w))
