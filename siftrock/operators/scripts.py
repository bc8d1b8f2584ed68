"""Rules on JavaScript and TypeScript: places found by patterns, then filters and joins on what was found there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftrock.operators.entry_points import Pattern, sites
from siftrock.operators.nesting import NOT_CODE, SCRIPT_SUFFIXES as SUFFIXES
from siftrock.operators.syntax import LARGE
from siftrock.sinks.shared import written

# ---- fixed values

LITERAL = r"""true|1|"[^"]+"|'[^']+'|\d+"""
CONSUMED = r"^\s*(?:(?:await|return|void|yield|throw|for|if|while|do) |(?:(?:const|let|var)\s+)?[\w$.\[\]]+(?:\s*:\s*[\w$<>,]+)?\s*[+\-*/%&|^]?=\s)"
PROMISING = r"fetch\(|Promise\.|\.(?:then|all|race|any)\("
PATTERNS = {
    "catch": Pattern("", "catch", SUFFIXES, r"catch\s*(?:\([^)]*\))?\s*\{(?P<body>[^{}]*(?:\{[^{}]*\}[^{}]*)*)\}", "{body}"),
    "optional": Pattern("", "optional", SUFFIXES, r"\?\.\s*(?P<name>json|parse|fetch|text|blob|formData|JSON\.parse)\s*\(", "{name}"),
    "equal": Pattern("", "equal", SUFFIXES, rf"expect\s*\(\s*(?P<arg>{LITERAL})\s*\)\s*\.(?:toBe|toEqual|toStrictEqual)\(\s*(?P=arg)\s*\)", "{arg}"),
    "truthy": Pattern("", "truthy", SUFFIXES, rf"expect\s*\(\s*(?P<arg>{LITERAL})\s*\)\s*\.toBeTruthy\(\s*\)", "{arg}"),
    "read": Pattern("", "read", SUFFIXES, r"\b(?P<name>readFileSync|readFile)\s*\(\s*(?P<path>\"[^\"]+\"|'[^']+')", "{name} {path}"),
    "floating": Pattern("", "floating", SUFFIXES, r"(?m)^(?P<line>[^\S\n]*(?:[\w$.\[\]]+\.)?(?:fetch|then|catch|finally|all|race|any|allSettled)[^\S\n]*\([^\n]*)", "{line}", NOT_CODE.pattern),
    "promise": Pattern("", "promise", SUFFIXES, r"Promise\.(?P<name>all|race|any|allSettled)\s*\(", "{name}", NOT_CODE.pattern),
    "guard": Pattern("", "guard", SUFFIXES, r"\.catch\(|try[ {]", "", NOT_CODE.pattern),
}


def _finding(rows: DataFrame, code, severity, category: str, message: Column) -> DataFrame:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return rows.select("path", F.col("line_no").alias("line"), lit(severity).alias("severity"), F.lit(category).alias("category"), lit(code).alias("code"), message.alias("message"))


def _named(files: DataFrame) -> DataFrame:
    names = F.array(*[F.lit(k) for k in PATTERNS])
    return sites(files, list(PATTERNS.values())).withColumn("kind", F.get(names, F.col("rule")))


def catches(found: DataFrame) -> DataFrame:
    """Catch blocks that hold nothing, or only write to the console; comments don't count."""
    body = F.trim(F.regexp_replace("symbol", r"//[^\n]*|/\*[\s\S]*?\*/|[\s&&[^ ]]+", " "))
    rows = found.where("kind = 'catch'").withColumn("body", body)
    statements = F.filter(F.transform(F.split("body", ";"), lambda s: F.trim(s)), lambda s: s != "")
    only = F.forall(statements, lambda s: s.rlike(r"^console\.(?:error|warn|info|log|debug)\b")) & ~F.col("body").rlike(r"throw[ ;]|return |process\.exit")
    rows = rows.withColumn("code", F.when(F.col("body") == "", "CATCH_EMPTY").when(only, "CATCH_CONSOLE_ONLY")).where("code IS NOT NULL")
    return _finding(rows, F.col("code"), F.when(F.col("code") == "CATCH_EMPTY", "warning").otherwise("nit"), "silent_failure", F.substring("body", 1, 120))


def promises(found: DataFrame) -> DataFrame:
    """Promises that a statement drops, and heads without a guard within two lines."""
    line = F.col("symbol")
    dropped = found.where((F.col("kind") == "floating") & line.rlike(PROMISING) & ~line.rlike(CONSUMED) & ~line.contains(".catch("))
    near = found.where("kind = 'guard'").select("path", F.explode(F.sequence(F.col("line_no") - 2, F.col("line_no") + 2)).alias("line_no")).distinct()
    bare = found.where("kind = 'promise'").join(near, ["path", "line_no"], "left_anti")
    out = _finding(dropped, "FLOATING_PROMISE", "warning", "floating_promise", F.substring(F.trim(line), 1, 120))
    return out.unionByName(_finding(bare, "PROMISE_NO_CATCH", "warning", "promise_no_catch", F.concat(F.lit("Promise."), line)))


def expectations(found: DataFrame) -> DataFrame:
    """Expectations of literals in test files."""
    name = F.substring_index("path", "/", -1)
    rows = found.where(F.col("kind").isin("equal", "truthy") & (name.contains(".test.") | name.contains(".spec.")))
    return _finding(rows, F.when(F.col("kind") == "equal", "JS_EXPECT_TRUE").otherwise("JS_EXPECT_TRUTHY"), "error", "assert_true_literal", F.col("symbol"))


def reads(found: DataFrame) -> DataFrame:
    """Whole reads: of what looks large by any call, of anything by the blocking one."""
    literal = F.regexp_replace("symbol", "^[A-Za-z]+ ", "")
    code = F.when(literal.rlike(LARGE), "JS_LARGE_FILE_SYNC_READ").when(F.col("symbol").startswith("readFileSync"), "JS_SYNC_FILE_READ")
    rows = found.where("kind = 'read'").withColumn("code", code).where("code IS NOT NULL")
    return _finding(rows, F.col("code"), F.when(F.col("code") == "JS_SYNC_FILE_READ", "nit").otherwise("warning"), "file_read", F.col("symbol"))


def all_scripts(files: DataFrame) -> DataFrame:
    found = written(_named(files), "script-sites")  # read by every rule
    optional = _finding(found.where("kind = 'optional'"), "OPTIONAL_CHAIN_FALLIBLE", "nit", "optional_chain_fallible", F.col("symbol"))
    return catches(found).unionByName(promises(found)).unionByName(expectations(found)).unionByName(reads(found)).unionByName(optional)
