"""Outputs of external linters as findings: (tool, path, line, column, severity, code, message).

``outputs`` has tool, stdout and stderr. Documents in JSON are read by schema, one tool's rows at a time, and
line formats by pattern. What is blank or no JSON of the expected shape gives no rows and no error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftrock.functions.text import lines, severity

COLUMNS = ("tool", "path", "line", "column", "severity", "code", "message")

#: Schema of a tool's document, what to explode in turn, and the findings' fields.
DOCUMENTS = {
    "ruff": ("array<struct<filename:string,location:struct<row:int,column:int>,fix:string,code:string,message:string>>", ["d"], ("x.filename", "x.location.row", "x.location.column", "if(x.fix IS NULL, 'error', 'warning')", "x.code", "x.message")),
    "eslint": ("array<struct<filePath:string,messages:array<struct<line:int,column:int,severity:int,ruleId:string,message:string>>>>", ["d", "x.messages"], ("w.filePath", "x.line", "x.column", "if(coalesce(x.severity, 1) >= 2, 'error', 'warning')", "x.ruleId", "x.message")),
    "hadolint": ("array<struct<file:string,line:int,column:int,level:string,code:string,message:string>>", ["d"], ("x.file", "x.line", "x.column", "x.level", "x.code", "x.message")),
    "sqlfluff": ("array<struct<filepath:string,violations:array<struct<line_no:int,line_pos:int,code:string,description:string>>>>", ["d", "x.violations"], ("w.filepath", "x.line_no", "x.line_pos", "'warning'", "x.code", "x.description")),
    "gitleaks": ("array<struct<File:string,StartLine:int,StartColumn:int,RuleID:string,Description:string>>", ["d"], ("x.File", "x.StartLine", "x.StartColumn", "'error'", "x.RuleID", "x.Description")),
    "semgrep": ("struct<results:array<struct<path:string,start:struct<line:int,col:int>,check_id:string,extra:struct<severity:string,message:string>>>>", ["d.results"], ("x.path", "x.start.line", "x.start.col", "x.extra.severity", "x.check_id", "x.extra.message")),
    "bandit": ("struct<results:array<struct<filename:string,line_number:int,col_offset:int,issue_severity:string,test_id:string,issue_text:string>>>", ["d.results"], ("x.filename", "x.line_number", "x.col_offset", "x.issue_severity", "x.test_id", "x.issue_text")),
}
MARKDOWN = "array<struct<fileName:string,lineNumber:int,ruleNames:array<string>,ruleDescription:string>>"
#: A document per line.
STREAMS = {
    "govulncheck": ("struct<finding:struct<osv:string,trace:array<struct<function:string,module:string,position:struct<filename:string,line:int,column:int>>>>>", "d.finding.trace", ("x.position.filename", "x.position.line", "x.position.column", "'error'", "d.finding.osv", "concat(coalesce(x.function, ''), ' via ', coalesce(x.module, ''))")),
    "clippy": ("struct<reason:string,message:struct<level:string,message:string,code:struct<code:string>,spans:array<struct<file_name:string,line_start:int,column_start:int>>>>", "if(d.reason = 'compiler-message', array(d.message), array())", ("x.spans[0].file_name", "x.spans[0].line_start", "x.spans[0].column_start", "x.level", "x.code.code", "x.message")),
}
#: Pattern, and the groups of path, line, column, severity, code and message (text: as it is).
TEXTS = {
    "mypy": (r"^([^:]+):(\d+)(?::(\d+))?:\s*(error|warning|note):\s*(.+?)(?:\s*\[([^\]]+)\])?\s*$", (1, 2, 3, 4, 6, 5)),
    "codespell": (r"^([^:]+):(\d+):\s*(.+)$", (1, 2, None, "nit", "typo", 3)),
    "govet": (r"^([^:]+\.go):(\d+):(\d+):\s*(.+)$", (1, 2, 3, "error", "vet", 4)),
}


def _named(rows: DataFrame, tool: str, fields: tuple[str, ...]) -> DataFrame:
    path, line, column, level, code, message = (F.expr(f) for f in fields)
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    whole = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    return rows.select(F.lit(tool).alias("tool"), text(path).alias("path"), whole(line).alias("line"), whole(column).alias("column"), severity(F.coalesce(level, F.lit("warning"))).alias("severity"), text(code).alias("code"), text(message).alias("message"))


def _documents(outputs: DataFrame, tool: str) -> DataFrame:
    schema, steps, fields = DOCUMENTS[tool]
    rows = outputs.where(F.col("tool") == tool).select(F.from_json("stdout", schema).alias("d"))
    rows = rows.select(F.explode(F.expr(steps[0])).alias("x"))
    for step in steps[1:]:
        rows = rows.select(F.col("x").alias("w"), F.explode(F.expr(step)).alias("x"))
    return _named(rows, tool, fields)


def _markdown(outputs: DataFrame) -> DataFrame:
    """A list of entries, or lists of them by file name."""
    mine = outputs.where(F.col("tool") == "markdownlint").select(F.trim("stdout").alias("s"))
    listed = mine.where("s LIKE '[%'").select(F.explode(F.from_json("s", MARKDOWN)).alias("x")).select("x.*")
    keyed = mine.where("s LIKE '{%'").select(F.explode(F.from_json("s", f"map<string,{MARKDOWN}>")).alias("file", "xs")).select("file", F.explode("xs").alias("x"))
    keyed = keyed.select(F.col("file").alias("fileName"), "x.lineNumber", "x.ruleNames", "x.ruleDescription")
    return _named(listed.unionByName(keyed), "markdownlint", ("fileName", "lineNumber", "0", "'warning'", "array_join(ruleNames, ',')", "ruleDescription"))


def _streams(outputs: DataFrame, tool: str) -> DataFrame:
    schema, step, fields = STREAMS[tool]
    each = lines(outputs.where(F.col("tool") == tool), path="tool", content="stdout")
    rows = each.select(F.from_json("line", schema).alias("d")).select("d", F.explode(F.expr(step)).alias("x"))
    return _named(rows, tool, fields)


def _texts(outputs: DataFrame, tool: str) -> DataFrame:
    pattern, groups = TEXTS[tool]
    mine = outputs.where(F.col("tool") == tool).select("tool", F.concat_ws("\n", "stdout", *(["stderr"] if tool == "govet" else [])).alias("said"))
    rows = lines(mine, path="tool", content="said").where(F.col("line").rlike(pattern))

    def field(g) -> Column:
        return F.nullif(F.regexp_extract("line", pattern, g), F.lit("")) if isinstance(g, int) else F.lit(g)

    names = ("a", "b", "c", "e", "f", "g")
    return _named(rows.select(*[field(g).alias(n) for g, n in zip(groups, names, strict=True)]), tool, ("a", "b", "c", "e", "f", "trim(g)"))


#: The document of the tool that gives places in bytes.
BIOME = "struct<diagnostics:array<struct<category:string,severity:string,description:string,location:struct<path:struct<file:string>,span:array<long>>>>>"


def line_starts(files: DataFrame) -> DataFrame:
    """(path, starts): the offsets in bytes at which the lines of a file begin, in order; lines end at line feeds. content: text, or the file's bytes."""

    def run(batches):
        for batch in batches:
            found = []
            for content in batch.column("content").to_pylist():
                data = np.frombuffer(content or b"", np.uint8)
                found.append(np.concatenate([np.zeros(1, np.int64), np.flatnonzero(data == 10) + 1]))
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(found, pa.list_(pa.int64()))], ["path", "starts"])

    rows = files.select(F.col("path").cast("string").alias("path"), F.coalesce(F.col("content").cast("binary"), F.lit(b"")).alias("content"))
    return rows.mapInArrow(run, "path string, starts array<long>")


def places(offsets: DataFrame, files: DataFrame) -> DataFrame:
    """(path, offset, line, column) of ``offsets`` (path, offset in bytes), each once: columns are in bytes, both count from 1; 0 and 0 in
    files that aren't there and before their beginning.

    A file's offsets meet its index once, however many there are, and are searched for in it.
    """
    asked = offsets.where("path IS NOT NULL AND offset >= 0").groupBy("path").agg(F.sort_array(F.collect_set("offset")).alias("offsets"))
    known = files.join(asked.select("path"), "path", "left_semi").dropDuplicates(["path"])
    rows = asked.join(line_starts(known), "path")

    def run(batches):
        for batch in batches:
            out = []
            for path, some, starts in zip(*(batch.column(c).to_pylist() for c in ("path", "offsets", "starts")), strict=True):
                at = np.searchsorted(starts, some, side="right")
                out += zip([path] * len(some), some, at.tolist(), (np.array(some) - np.array(starts)[at - 1] + 1).tolist())
            cols = list(zip(*out)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int32(), pa.int32()))], ["path", "offset", "line", "column"])

    return rows.mapInArrow(run, "path string, offset long, line int, column int")


def biome(outputs: DataFrame, files: DataFrame) -> DataFrame:
    """Findings of the tool whose spans are offsets in bytes of ``files`` (path, content)."""
    each = outputs.where("tool = 'biome'").select(F.explode(F.from_json("stdout", BIOME)["diagnostics"]).alias("x"))
    offset = F.when(F.size("x.location.span") > 0, F.get("x.location.span", F.lit(0))).otherwise(F.lit(0))
    rows = each.select(F.coalesce("x.location.path.file", F.lit("")).alias("path"), F.coalesce(offset, F.lit(0)).cast("long").alias("offset"), "x.severity", "x.category", "x.description")
    found = rows.join(places(rows.select("path", "offset"), files), ["path", "offset"], "left")
    return _named(found, "biome", ("path", "line", "column", "severity", "category", "description"))


def normalised(outputs: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Findings of every tool. Places of one are in bytes and need the ``files``; without these it is left out."""
    parts = [_documents(outputs, t) for t in DOCUMENTS] + [_streams(outputs, t) for t in STREAMS] + [_texts(outputs, t) for t in TEXTS] + [_markdown(outputs)] + ([biome(outputs, files)] if files is not None else [])
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out
