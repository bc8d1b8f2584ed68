"""Queries of rules on structure: files are built from the columns of ``part``, so that sizes, names, nesting and places are theirs, and the SQL
derives what must be found from the same columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftrock.functions.batches import spread
from siftrock.operators import linters, nesting, python_ast
from siftrock.sources.tables import table


def made(spark, d, path: str, content: str, name: str = "part") -> DataFrame:
    """path and content of a file for each row of a table, as SQL expressions of its columns."""
    return spread(table(spark, d, name)).select(F.expr(path).alias("path"), F.expr(content).alias("content"))


def channel_sends(spark, d):
    """Go files that close a channel and send to it p_size lines below: in code, in a comment or a raw string over lines, below a comment, elsewhere."""
    tail = r"""CASE p_partkey % 6 WHEN 0 THEN '\tch <- x\n' WHEN 1 THEN '\t/* one\nch <- x\n*/\n' WHEN 2 THEN '\ts := `one\nch <- x\n`\n'
      WHEN 3 THEN '\t// ch <- x\n\tch <- y\n' WHEN 4 THEN '\tother <- x\n' ELSE '\tch <- x // "\n' END"""
    head = r"""CASE WHEN p_partkey % 6 = 5 THEN '/* "\n\tclose(ch)\n*/' ELSE '\tclose(ch)' END"""
    return nesting.sends_after_close(made(spark, d, "p_partkey || '.go'", rf"{head} || repeat('\n\tx++', p_size - 1) || '\n' || {tail}"))


CHANNELS = """SELECT p_partkey || '.go' AS path, (p_size + CASE WHEN p_partkey % 6 = 0 THEN 1 ELSE 2 END)::INT AS line, 'error' AS severity, 'channel_send_after_close' AS category,
  'CHANNEL_SEND_AFTER_CLOSE' AS code, '`ch <- ...` appears after `close(ch)` — sends on a closed channel panic at runtime' AS message
FROM part WHERE (p_partkey % 6 = 0 AND p_size <= 20) OR (p_partkey % 6 = 3 AND p_size < 20)"""


def script_structure(spark, d):
    """Functions of p_size + 5 lines with braces in comments, tests with and without assertions, queries within loops that may nest."""
    head = """CASE p_partkey % 4 WHEN 0 THEN 'function f' || p_partkey || '(a) {' WHEN 1 THEN 'const f' || p_partkey || ' = async (a) => {'
      WHEN 2 THEN 'let f' || p_partkey || ' = x => {' ELSE '// function f' || p_partkey || '(a) {' END"""
    long = rf"""{head} || '\n' || repeat('  g() // }}\n', p_size) || '  if (a) {{\n    h()\n  }}\n' || if(p_partkey % 5 = 0, '', '}}\n')"""
    one = made(spark, d, "p_partkey || '/f.ts'", long)
    body = r"""CASE p_partkey % 3 WHEN 0 THEN '  expect(a)\n' WHEN 1 THEN '' ELSE '  if (b) { c() }\n' END"""
    two = made(spark, d, "p_partkey || if(p_partkey % 2 = 0, '/t.test.js', '/t.js')", rf"""repeat('\n', p_size) || 'it("works", async () => {{\n' || {body} || '}})\n'""")
    loop = """CASE p_partkey % 4 WHEN 0 THEN 'for (const x of xs) {' WHEN 1 THEN 'xs.map(x => {' WHEN 2 THEN 'for (let i = 0; i < n; i++) {' ELSE 'while (a) { xs.forEach(x => {' END"""
    three = made(spark, d, "p_partkey || '/l.mjs'", rf"""{loop} || '\n' || repeat('  if (y) {{ a(x) }}\n', p_size) || '  db.query(x)\n' || if(p_partkey % 4 = 3, '}})', '') || '}}\n' || 'db.exec(y)\n'""")
    return nesting.script_blocks(one.unionByName(two).unionByName(three))


SCRIPTS = """SELECT p_partkey || '/f.ts' AS path, 1 AS line, 'nit' AS severity, 'fn_too_long' AS category, 'FN_TOO_LONG_REGEX' AS code,
  'JS/TS function `f' || p_partkey || '` spans ' || (p_size + 5) || ' lines (max 20)' AS message FROM part WHERE p_partkey % 5 <> 0 AND p_size > 15
UNION ALL SELECT p_partkey || '/t.test.js', p_size + 1, 'warning', 'no_assertion', 'JS_NO_ASSERTION', 'JS/TS test body has no assertion shape — test always passes'
FROM part WHERE p_partkey % 2 = 0 AND p_partkey % 3 > 0
UNION ALL SELECT p_partkey || '/l.mjs', p_size + 2, 'warning', 'n_plus_one', 'JS_N_PLUS_ONE_LOOP', 'DB-shape call inside a `for`/`while`/`.forEach(`/`.map(` body — classic N+1 anti-pattern'
FROM part WHERE p_partkey % 4 <> 2"""


def go_loop_queries(spark, d):
    """Go: a query in a loop, in a closure within it, behind it, behind a loop within it, or on the loop's own line."""
    inside = r"""CASE p_partkey % 5 WHEN 0 THEN '\t\trows := db.Query(q)\n\t}\n' WHEN 1 THEN '\t\tgo func() {\n\t\t\ttx.ExecContext(q)\n\t\t}()\n\t}\n' WHEN 2 THEN '\t}\n\tdb.Exec(q)\n'
      WHEN 3 THEN '\t\tfor y := range ys {\n\t\t}\n\t\tdb.QueryRow(q)\n\t}\n' ELSE '\t}\n\tfor db.Query(q) {\n\t}\n' END"""
    return nesting.go_loops(made(spark, d, "p_partkey || '.go'", rf"'func f() {{\n\tfor _, x := range xs {{\n' || repeat('\t\tif x {{\n\t\t\tg(x)\n\t\t}}\n', p_size) || {inside} || '}}\n'"))


GO_LOOPS = """SELECT p_partkey || '.go' AS path, (3 * p_size + CASE p_partkey % 5 WHEN 0 THEN 3 ELSE 4 END)::INT AS line, 'warning' AS severity, 'n_plus_one' AS category, 'GO_DB_IN_LOOP' AS code,
  '`.' || CASE p_partkey % 5 WHEN 1 THEN 'ExecContext' ELSE 'Query' END || '(...)` inside `for` block — classic N+1 anti-pattern' AS message
FROM part WHERE p_partkey % 5 IN (0, 1, 4)"""


def state_of_modules(spark, d):
    """Containers under names of parts: at the margin or in a function, empty or not, with comments, types and odd spaces."""
    value = "CASE p_size % 7 WHEN 0 THEN '{}' WHEN 1 THEN '[]' WHEN 2 THEN 'set()' WHEN 3 THEN '{1: 2}' WHEN 4 THEN 'dict()  # filled later' WHEN 5 THEN '{ }' ELSE 'list()' END"
    name = "replace(p_name, ' ', '_') || CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN ': dict[str, int]' ELSE ' ' END"
    where = r"CASE p_partkey % 3 WHEN 0 THEN 'def f():\n    x = 1\n\n    ' WHEN 1 THEN 'def f():\n    x = []\n' ELSE repeat('# a\n', p_size) END"
    return nesting.module_state(made(spark, d, "p_partkey || CASE WHEN p_partkey % 11 = 0 THEN '/a.txt' ELSE '/a.py' END", rf"{where} || {name} || ' = ' || {value} || '\nb = 1\n'"))


STATES = """SELECT p_partkey || '/a.py' AS path, CASE p_partkey % 3 WHEN 1 THEN 3 ELSE p_size + 1 END::INT AS line, 'nit' AS severity, 'module_level_mutable_state' AS category, 'MODULE_STATE' AS code,
  'Top-level mutable container ''' || replace(p_name, ' ', '_') || ''' may accumulate cross-tenant data; verify it is scoped per-tenant or rebuilt per-request' AS message
FROM part WHERE p_partkey % 3 > 0 AND p_partkey % 11 > 0 AND p_size % 7 NOT IN (3, 5)"""

#: Measures of the function of a row: lines of conditions, nested blocks, and what counts or doesn't in it.
MEASURES = """SELECT *, p_size % 8 AS ifs, p_partkey % 5 AS deep, (p_partkey % 2)::INT AS odd, (p_partkey % 3 = 0)::INT AS own FROM part"""


def function_measures(spark, d):
    """Python functions of a row's numbers of parameters, branches and depth; a class within counts, a function within and ternaries don't."""
    t = spread(table(spark, d, "part")).selectExpr("*", "p_size % 8 AS ifs", "p_partkey % 5 AS deep", "p_partkey % 2 AS odd", "p_partkey % 3 = 0 AS own")
    nested = r"CASE deep WHEN 0 THEN '    pass' WHEN 1 THEN '    with x:\n        pass' WHEN 2 THEN '    match x:\n        case 1:\n            while x and y:\n                pass' " \
        r"WHEN 3 THEN '    try:\n        for x in y:\n            with x:\n                pass\n    except* A:\n        pass' " \
        r"ELSE '    for x in y:\n        if x:\n            if y:\n                with z:\n                    pass' END"  # fmt: skip
    content = rf"""'def f(' || array_join(transform(sequence(1, 1 + p_size % 6), i -> 'a' || i), ', ') || '):\n' || repeat('    if x: y = 1 if z else 2\n', int(ifs)) || {nested} || '\n'
      || if(odd = 1, '    class C:\n        if x: pass\n        if x: pass\n', '') || if(own, '    def g():\n        if x: pass\n        if x: pass\n', '')"""
    files = t.select(F.expr("p_partkey || '.py'").alias("path"), F.expr(content).alias("content"))
    return python_ast.complexity(files)


FUNCTIONS = f"""WITH m AS ({MEASURES}),
f AS (SELECT p_partkey || '.py' AS path, 1 AS line, 'f' AS name, 1 + p_size % 6 AS params,
    ifs + CASE deep WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 3 WHEN 3 THEN 3 ELSE 4 END + 2 * odd AS branches,
    greatest(CASE WHEN ifs > 0 OR odd > 0 THEN 1 ELSE 0 END, CASE deep WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 ELSE 4 END) AS depth,
    1 + ifs + CASE deep WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 WHEN 3 THEN 6 ELSE 5 END + 3 * odd + 3 * own AS length FROM m)
SELECT path, line, x.s AS severity, 'complexity' AS category, x.c AS code, name || ': ' || x.v AS message FROM (
  SELECT *, unnest([{{c: 'FN_TOO_LONG', s: 'nit', v: length, m: 20}}, {{c: 'TOO_MANY_PARAMS', s: 'nit', v: params, m: 3}}, {{c: 'TOO_MANY_BRANCHES', s: 'nit', v: branches, m: 5}},
    {{c: 'HIGH_COMPLEXITY', s: 'warning', v: branches, m: 9}}, {{c: 'DEEP_NESTING', s: 'nit', v: depth, m: 2}}]) AS x FROM f) WHERE x.v > x.m"""


def byte_places(spark, d):
    """A linter's offsets in bytes as lines and columns: two in each document, of any letters, one behind its end and one in a file that isn't there."""
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.coalesce("text", F.lit("")).alias("content"))
    at = F.array((F.col("path").cast("long") * 37 % (F.length("content") + 1)).cast("int"), (F.col("path").cast("long") * 1009 % (F.length("content") + 1)).cast("int"))
    offsets = F.transform(at, lambda k: F.octet_length(F.substring(F.col("content"), F.lit(1), k)).cast("long"))
    offsets = F.concat(offsets, F.array(F.octet_length("content").cast("long") + 5))
    spot = lambda path, offset: F.struct(F.lit("lint/a").alias("category"), F.lit("error").alias("severity"), F.lit("odd").alias("description"), F.struct(F.struct(path.alias("file")).alias("path"), F.array(offset, offset + 1).alias("span")).alias("location"))
    each = F.concat(F.transform(offsets, lambda o: spot(F.col("path"), o)), F.array(spot(F.concat(F.lit("no/"), "path"), F.lit(7).cast("long"))))
    outputs = docs.select(F.lit("biome").alias("tool"), F.to_json(F.struct(each.alias("diagnostics"))).alias("stdout"))
    return linters.biome(outputs, docs)


PLACES = """WITH d AS (SELECT doc_id::VARCHAR AS path, doc_id, coalesce(text, '') AS text FROM documents),
k AS (SELECT path, left(text, (doc_id * 37 % (length(text) + 1))::INT) AS head, 0 AS more FROM d UNION ALL SELECT path, left(text, (doc_id * 1009 % (length(text) + 1))::INT), 0 FROM d UNION ALL SELECT path, text, 5 FROM d),
f AS (SELECT path, (length(head) - length(replace(head, chr(10), '')) + 1)::INT AS line, (strlen(string_split(head, chr(10))[-1]) + 1 + more)::INT AS "column" FROM k UNION ALL SELECT 'no/' || path, 0, 0 FROM d)
SELECT 'biome' AS tool, path, line, "column", 'error' AS severity, 'lint/a' AS code, 'odd' AS message FROM f"""


def queries() -> dict:
    return {f.__name__: f for f in (channel_sends, script_structure, go_loop_queries, state_of_modules, function_measures, byte_places)}


def oracle_sql() -> dict[str, str]:
    return {"channel_sends": CHANNELS, "script_structure": SCRIPTS, "go_loop_queries": GO_LOOPS, "state_of_modules": STATES, "function_measures": FUNCTIONS, "byte_places": PLACES}
