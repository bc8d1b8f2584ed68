"""Measures of Python functions. Syntax trees need Python: a small Arrow function gives one row for each function, all
thresholds are column expressions. Files that don't parse give no rows."""

from __future__ import annotations

import ast

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftrock.functions.batches import gathered, texts

FUNCTIONS = "path string, line_no int, name string, length int, params int, branches int, depth int, documented boolean"
# ---- fixed values: what branches, and what nests

BRANCHES = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.TryStar, ast.With, ast.AsyncWith, ast.Match)


def _inside(function):
    """All that belongs to a function, with its depth: its signature and body, classes and lambdas in it, but no function defined within."""
    todo = [(function, 0)]
    while todo:
        at, depth = todo.pop()
        depth += isinstance(at, BRANCHES)
        yield at, depth
        todo += [(child, depth) for child in ast.iter_child_nodes(at) if not isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef))]


def _weight(node) -> int:
    if isinstance(node, ast.BoolOp):
        return len(node.values) - 1
    return len(node.ifs) if isinstance(node, ast.comprehension) else isinstance(node, BRANCHES)


def measures(text: str | None):
    try:
        tree = ast.parse(text or "")
    except (SyntaxError, ValueError, RecursionError):
        return
    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            a = node.args
            inner = list(_inside(node))
            params = len(a.posonlyargs) + len(a.args) + len(a.kwonlyargs) + bool(a.vararg) + bool(a.kwarg)
            yield node.lineno, node.name, node.end_lineno - node.lineno + 1, params, sum(_weight(n) for n, _ in inner), max(d for _, d in inner), ast.get_docstring(node) is not None


def functions(files: DataFrame) -> DataFrame:
    def run(batches):
        kinds = (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_())
        names = [c.split()[0] for c in FUNCTIONS.split(", ")]
        return gathered(((p, *m) for p, t in texts(batches) for m in measures(t)), kinds, names)

    return files.select(F.col("path").cast("string").alias("path"), "content").mapInArrow(run, FUNCTIONS)


#: Code, severity, measure and the most that is allowed.
LIMITS = (("FN_TOO_LONG", "nit", "length", 20), ("TOO_MANY_PARAMS", "nit", "params", 3), ("TOO_MANY_BRANCHES", "nit", "branches", 5), ("HIGH_COMPLEXITY", "warning", "branches", 9), ("DEEP_NESTING", "nit", "depth", 2))


def complexity(files: DataFrame) -> DataFrame:
    over = F.array_compact(F.array(*[F.when(F.col(m) > n, F.struct(F.lit(c).alias("code"), F.lit(s).alias("severity"), F.col(m).alias("value"))) for c, s, m, n in LIMITS]))
    rows = functions(files).select("path", "line_no", "name", F.explode(over).alias("x"))
    return rows.select("path", F.col("line_no").alias("line"), "x.severity", F.lit("complexity").alias("category"), "x.code", F.concat_ws(": ", "name", F.col("x.value").cast("string")).alias("message"))
