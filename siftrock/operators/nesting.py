"""Rules on what brackets, strings and indents enclose, over the whole text of a file.

What is code and what is a comment or a string is decided by state that crosses lines, and a bracket's partner may be anywhere below it. These need the text
in order, once: Arrow functions find the places in one pass, a row for each; thresholds, names and joins of places are column expressions.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from siftrock.functions.batches import gathered, texts
from siftrock.functions.text import LINE_BREAK, lines
from siftrock.sinks.shared import written

# ---- fixed values

SCRIPT_SUFFIXES = (".js", ".mjs", ".cjs", ".jsx", ".ts", ".tsx", ".mts", ".cts")
STATE_SUFFIXES = (".py", ".js", ".ts", ".tsx", ".mjs", ".cjs")
FUNCTION_HEAD = r"(?:^|\W)(?:function\s+(?P<n1>[\w$]+)\s*\([^)]*\)|(?:const|let|var)\s+(?P<n2>[\w$]+)\s*(?::\s*[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)|[\w$]+)\s*=>)\s*\{"
MAX_LINES = 20
TEST_HEAD = r"\b(?:test|it)\s*\(\s*['\"`][^'\"`]+['\"`]\s*,\s*(?:async\s*)?\(\s*\)\s*=>\s*\{"
ASSERTIONS = ("expect(", "assert(", "assert.", "should.", "chai.expect(", ".toThrow(")
LOOP_HEADS = (r"\bfor\s*\(", r"\bwhile\s*\(", r"\.forEach\s*\(", r"\.map\s*\(", r"\.flatMap\s*\(", r"\bfor\s+await\s*\(")
SCRIPT_QUERY = r"\b(?:db|client|conn|tx|store)\.(?:query|exec|execute|find|findOne|findMany|aggregate|insert|update|delete)\s*\(|\b(?:prisma|knex|sequelize|drizzle)\.[\w.]+\."
GO_LOOP = r"\s*for\b[^{]*\{"
GO_QUERY = r"\b(?:db|tx)\.(Query|QueryContext|Exec|ExecContext|QueryRow)\s*\("
EMPTY_STATE = r"^(?<name>[A-Z_][A-Z0-9_]+|[a-z][a-z0-9_]*)(?:\s*:\s*[\w\[\]\., ]+)?\s*=\s*(?:\{\}|\[\]|set\(\)|dict\(\)|list\(\))\s*(?:#.*)?$"
CLOSE = r"^\s*close\(\s*(\w+)\s*\)"
SEND = r"(\w+)\s*<-\s*[^<]"
SEND_WITHIN = 20

_BREAK = r"\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029"
#: A line comment, a block comment, or a string of any of three kinds, up to their ends or that of the text. An escape takes no line break.
NOT_CODE = re.compile(
    rf"//[^{_BREAK}]*|/\*(?:[^*]|\*(?!/))*(?:\*/|\Z)" + "".join(rf"|{q}(?:\\[^{_BREAK}]|\\(?=[{_BREAK}]|\Z)|[^\\{q}])*(?:{q}|\Z)" for q in "\"'`")
)
_NO_BREAKS = re.compile(f"[^{_BREAK}]+")


def code_of(text: str) -> str:
    """``text`` without comments and the inside of strings, and with all of its line breaks, so that lines keep their numbers."""
    return NOT_CODE.sub(lambda m: _NO_BREAKS.sub("", m[0]), text)


def _codes(content: pd.Series) -> pd.Series:
    return content.map(code_of, na_action="ignore")


def code_only(content: Column) -> Column:
    """``code_of`` of a column. Nulls stay."""
    return F.pandas_udf(_codes, StringType())(content)


def _suffixed(files: DataFrame, suffixes: Sequence[str]) -> DataFrame:
    path = F.lower(F.col("path").cast("string"))
    return files.where(F.concat(F.lit("."), F.substring_index(path, ".", -1)).isin(*suffixes) & F.substring_index(path, "/", -1).contains("."))


def _finding(rows: DataFrame, code: str, severity: str, category: str, message: Column) -> DataFrame:
    return rows.select("path", F.col("line_no").cast("int").alias("line"), F.lit(severity).alias("severity"), F.lit(category).alias("category"), F.lit(code).alias("code"), message.alias("message"))


# ---- brackets

BLOCKS = "path string, kind int, name string, line_no int, length int, closed boolean, probe_line int"


@dataclass(frozen=True)
class Block:
    """What braces enclose behind a match of ``head``: the match ends with the brace, or the brace is the next of ``{`` and ``;`` behind it
    (``ahead``). ``comments``: braces in line comments don't count. ``probe`` is looked for inside."""

    head: str
    ahead: bool = False
    comments: bool = False
    probe: str | None = None


def partners(text: str, comments: bool, start: int = 0) -> dict[int, int]:
    """Where each brace that opens from ``start`` on is closed; those that never are have no place."""
    opened, out = [], {}
    for m in re.finditer(r"//[^\n]*|[{}]" if comments else r"[{}]", text[start:] if start else text):
        if m[0] == "{":
            opened.append(start + m.start())
        elif m[0] == "}" and opened:
            out[opened.pop()] = start + m.start()
            if start and not opened:  # the one brace that was asked for
                break
    return out


def blocks_in(text: str, kinds: Sequence[Block]):
    """(kind, name, line, length in lines, closed, line of the probe) of each block; lines end at line feeds."""
    ends = np.array([m.start() for m in re.finditer("\n", text)], np.int64)
    line = lambda at: int(np.searchsorted(ends, at)) + 1
    known = {c: partners(text, c) for c in {k.comments for k in kinds}}
    for number, kind in enumerate(kinds):
        for m in re.finditer(kind.head, text):
            at = m.end() - 1
            if kind.ahead:
                found = re.compile("[{;]").search(text, m.end())
                if found is None or found[0] == ";":
                    continue
                at = found.start()
            close = known[kind.comments].get(at)
            if close is None and kind.comments:
                close = partners(text, True, at).get(at)  # the head is in a comment itself
            stop = len(text) if close is None else close
            probe = re.search(kind.probe, text[at + 1 : stop]) if kind.probe else None
            name = next((v for v in m.groupdict().values() if v), None)
            yield number, name, line(m.start()), line(stop) - line(m.start()) + 1, close is not None, line(at + 1 + probe.start()) if probe else None


def blocks(files: DataFrame, kinds: Sequence[Block]) -> DataFrame:
    """Every block of every kind, all kinds in one pass. Null and empty texts have none."""
    types = (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.int32())
    names = [c.split()[0] for c in BLOCKS.split(", ")]

    def run(batches):
        return gathered(((path, *b) for path, text in texts(batches) for b in blocks_in(text or "", kinds)), types, names)

    return files.select(F.col("path").cast("string").alias("path"), "content").mapInArrow(run, BLOCKS)


SCRIPT_BLOCKS = (
    Block(FUNCTION_HEAD, comments=True),
    Block(TEST_HEAD, probe="|".join(map(re.escape, ASSERTIONS))),
    Block("|".join(LOOP_HEADS), ahead=True, probe=SCRIPT_QUERY),
)


def script_blocks(files: DataFrame) -> DataFrame:
    """JavaScript and TypeScript: functions of more than ``MAX_LINES`` lines, tests without an assertion, queries in loops."""
    found = written(blocks(_suffixed(files, SCRIPT_SUFFIXES), SCRIPT_BLOCKS), "script-blocks")  # read for each kind
    long = found.where(f"kind = 0 AND closed AND length > {MAX_LINES}")
    long = _finding(long, "FN_TOO_LONG_REGEX", "nit", "fn_too_long", F.format_string(f"JS/TS function `%s` spans %d lines (max {MAX_LINES})", F.coalesce("name", F.lit("<anonymous>")), "length"))
    base = F.substring_index("path", "/", -1)
    bare = found.where((F.col("kind") == 1) & F.col("closed") & F.col("probe_line").isNull() & (base.contains(".test.") | base.contains(".spec.")))
    bare = _finding(bare, "JS_NO_ASSERTION", "warning", "no_assertion", F.lit("JS/TS test body has no assertion shape — test always passes"))
    asked = found.where("kind = 2 AND probe_line IS NOT NULL").select("path", F.col("probe_line").alias("line_no")).distinct()  # once for all loops around it
    asked = _finding(asked, "JS_N_PLUS_ONE_LOOP", "warning", "n_plus_one", F.lit("DB-shape call inside a `for`/`while`/`.forEach(`/`.map(` body — classic N+1 anti-pattern"))
    return long.unionByName(bare).unionByName(asked)


# ---- depths

CALLS = "path string, line_no int, name string"


def looped_calls(text: str):
    """(line, call) of Go queries within the loop that began last, as long as that is open.

    Depths are prefix sums of the braces of lines. A loop is open below its head while no depth since falls back to that of the head, which no
    more braces may close than open before.
    """
    each = text.splitlines()
    asked = [(i, m[1]) for i, x in enumerate(each) if (m := re.search(GO_QUERY, x))]
    heads = [i for i, x in enumerate(each) if re.match(GO_LOOP, x)] if asked else []
    if not heads:
        return
    change = np.array([x.count("{") - x.count("}") for x in each])
    depth = np.concatenate([[0], np.cumsum(change)])  # before each line, and after the last
    stop = {}
    for head, after in zip(heads, [*heads[1:], len(each)]):
        low = np.flatnonzero(depth[head + 1 : after + 1] <= depth[head])
        stop[head] = head + 1 + int(low[0]) if len(low) else after  # the first line that isn't inside any more
    last = np.searchsorted(heads, [i for i, _ in asked], side="right") - 1
    for (i, name), k in zip(asked, last):
        if k >= 0 and depth[heads[k]] >= 0 and (i == heads[k] or i < stop[heads[k]]):
            yield i + 1, name


def go_loops(files: DataFrame) -> DataFrame:
    """Go: queries inside the body of a loop."""

    def run(batches):
        return gathered(((p, *c) for p, t in texts(batches) for c in looped_calls(t or "")), (pa.string(), pa.int32(), pa.string()), ["path", "line_no", "name"])

    found = _suffixed(files, (".go",)).select(F.col("path").cast("string").alias("path"), "content").mapInArrow(run, CALLS)
    return _finding(found, "GO_DB_IN_LOOP", "warning", "n_plus_one", F.format_string("`.%s(...)` inside `for` block — classic N+1 anti-pattern", "name"))


# ---- state of modules, and channels


def module_state(files: DataFrame) -> DataFrame:
    """Empty containers assigned to a name at the margin. A line there is outside every function, so no scope need be kept."""
    name = F.regexp_extract("line", EMPTY_STATE, 1)
    rows = lines(_suffixed(files, STATE_SUFFIXES)).withColumn("name", name).where("name != ''")
    message = F.format_string("Top-level mutable container '%s' may accumulate cross-tenant data; verify it is scoped per-tenant or rebuilt per-request", "name")
    return _finding(rows, "MODULE_STATE", "nit", "module_level_mutable_state", message)


def sends_after_close(files: DataFrame) -> DataFrame:
    """Go: the first line of the next ``SEND_WITHIN`` below the closing of a channel that sends to it first of all. Comments and
    strings, however many lines they take, are no code. Works on a file's array of lines, so nothing is shuffled."""
    content = F.split(code_only(F.col("content")), LINE_BREAK)
    sending = [F.col("content").cast("string").contains(c) for c in "(<-"]  # leaving comments and strings out adds no characters
    files = files.where(sending[0] & sending[1] & sending[2]).select("path", content.alias("_lines"))
    each = F.transform("_lines", lambda x, i: F.struct((i + 1).alias("line_no"), F.regexp_extract(x, CLOSE, 1).alias("name"), F.regexp_extract(x, SEND, 1).alias("to")))
    split = files.select("path", each.alias("_lines")).where(F.exists("_lines", lambda x: x["name"] != ""))
    closed = split.select("path", "_lines", F.explode(F.filter("_lines", lambda x: x["name"] != "")).alias("c"))
    below = F.slice("_lines", F.col("c.line_no") + 1, F.lit(SEND_WITHIN))
    sent = closed.select("path", "c.name", F.get(F.filter(below, lambda x: x["to"] == F.col("c.name")), F.lit(0))["line_no"].alias("line_no")).where("line_no IS NOT NULL")
    return _finding(sent, "CHANNEL_SEND_AFTER_CLOSE", "error", "channel_send_after_close", F.format_string("`%s <- ...` appears after `close(%s)` — sends on a closed channel panic at runtime", "name", "name"))


def all_nesting(files: DataFrame) -> DataFrame:
    return script_blocks(files).unionByName(go_loops(files)).unionByName(module_state(files)).unionByName(sends_after_close(_suffixed(files, (".go",))))
