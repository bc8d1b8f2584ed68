"""Queries of operators whose inputs the tables don't hold: files and tool outputs made from table rows, one set for each nation, and
what must be found in them as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftrock.operators import environment, linters, rules, scripts, syntax
from siftrock.sources.tables import table

PYTHON = {
    "handlers.py": 'try:\n    a()\nexcept:\n    pass\ntry:\n    a()\nexcept (ValueError, m.Exception):\n    log.error("x")\ntry:\n    a()\nexcept KeyError:\n    print(1)  # TODO later\n    sys.exit(2)\n',
    "calls.py": 'async def main(db, loop, q, items):\n    asyncio.create_task(g())\n    t = asyncio.create_task(g())\n    loop.run_in_executor(None, g)\n    for i in items:\n        db.query(i)\n    db.execute(f"select {q}")\n    db.execute("select ?", q)\n    open("big.csv").read()\nmain()\n',
    "names.py": 'import os, a.b\nfrom x import y as z, w\n__all__ = ["kept"]\ndef kept(): return z\ndef lone(): return os\nclass Lone: pass\n',
    "flow.py": "def f(n):\n    return f(n - 1)\n    print(n)\n@functools.lru_cache(None)\ndef g(n):\n    return g(n - 1)\nf(g(1))\n",
    "pkg/test_t.py": 'def test_none(): run()\ndef test_true():\n    assert True\n    assert run() == 1\ndef test_with():\n    with pytest.raises(ValueError): run()\n',
    "app/migrations/one.py": "def upgrade(): x()\nupgrade()\n",
    "app/migrations/two.py": "def upgrade(): x()\ndef downgrade(): pass\nupgrade(downgrade())\n",
    "text.py": '"""Todo"""\ndef google(a, b):\n    """Adds two numbers to one.\n\n    Args:\n        a (int): first of them\n        c: none\n    """\ngoogle(1, 2)\n',
}
PYTHON_FOUND = (
    ("handlers.py", 3, "SILENT_BARE"), ("handlers.py", 3, "SILENT_EMPTY"), ("handlers.py", 7, "BROAD_CATCH"), ("handlers.py", 7, "SILENT_LOG_ONLY"), ("handlers.py", 11, "TODO_IN_HANDLER"),
    ("calls.py", 2, "DETACHED_CREATE_TASK"), ("calls.py", 4, "LOOP_RUN_IN_EXECUTOR_NO_AWAIT"), ("calls.py", 6, "N_PLUS_ONE_LOOP"), ("calls.py", 7, "SQL_INJECTION_FSTRING"), ("calls.py", 9, "LARGE_FILE_FULL_READ"),
    ("names.py", 1, "UNUSED_IMPORT"), ("names.py", 2, "UNUSED_IMPORT"), ("names.py", 5, "ORPHAN_MODULE_DEF"), ("names.py", 6, "ORPHAN_MODULE_DEF"),
    ("flow.py", 1, "RECURSIVE_NO_MEMO"), ("flow.py", 3, "UNREACHABLE"),
    ("pkg/test_t.py", 1, "ORPHAN_MODULE_DEF"), ("pkg/test_t.py", 2, "ORPHAN_MODULE_DEF"), ("pkg/test_t.py", 5, "ORPHAN_MODULE_DEF"), ("pkg/test_t.py", 1, "NO_ASSERTION_TEST"), ("pkg/test_t.py", 3, "ASSERT_TRUE_LITERAL"),
    ("app/migrations/one.py", 1, "MISSING_DOWNGRADE"), ("app/migrations/two.py", 2, "EMPTY_DOWNGRADE"),
    ("text.py", 1, "TRIVIAL_DOCSTRING"), ("text.py", 2, "DOCSTRING_PARAM_GHOST"), ("text.py", 2, "DOCSTRING_PARAM_MISSING"),
)
SCRIPTS = {
    "c.js": "try { a() } catch (e) { }\ntry { a() } catch { /* no */\n // none\n}\ntry { a() } catch (e) { console.error(e); }\ntry { a() } catch (e) { console.log(e); throw e; }\n",
    "o.ts": "const x = r?.json()\nconst y = r.json()\n",
    "p.ts": "fetch('/a')\nawait fetch('/a')\nfetch('/a').catch(f)\nconst p = fetch('/a')\n// fetch('/a')\n\n\nPromise.all(xs)\n",
    "a.test.js": "expect(true).toBe(true)\nexpect(1).toEqual(2)\nexpect('a').toBeTruthy()\nexpect(x).toBe(true)\n",
    "f.js": "fs.readFileSync('a.txt')\nreadFile('a.csv', f)\nreadFile('a.txt', f)\n",
}
SCRIPTS_FOUND = (
    ("c.js", 1, "CATCH_EMPTY"), ("c.js", 2, "CATCH_EMPTY"), ("c.js", 5, "CATCH_CONSOLE_ONLY"), ("o.ts", 1, "OPTIONAL_CHAIN_FALLIBLE"),
    ("p.ts", 1, "FLOATING_PROMISE"), ("p.ts", 8, "FLOATING_PROMISE"), ("p.ts", 8, "PROMISE_NO_CATCH"),
    ("a.test.js", 1, "JS_EXPECT_TRUE"), ("a.test.js", 3, "JS_EXPECT_TRUTHY"), ("f.js", 1, "JS_SYNC_FILE_READ"), ("f.js", 2, "JS_LARGE_FILE_SYNC_READ"),
)
LINES = {
    "names.py": "def pay_v2(): pass\ndef pay(): pass\n",
    "made.py": "# Code generated by tool. DO NOT EDIT.\nx = 1\n",
    "app/db.sql": "alter table t add c int;\n  DROP TABLE t;\n-- alter table\n",
    "app/migrations/db.sql": "ALTER TABLE t add c int;\n",
    "count.py": "limit = 5  # at most 7 tries\nlimit = 5  # at most 5 tries\n",
    "cache.py": "cache.get(key)\n\n\n\ncache.get(tenant_id)\n",
    "send.go": "close(done)\nx = 1\ndone <- 1\n",
    "go.go": "go run()\n\n\n\n\n\ngo wait()\nwg.Wait()\n",
}
LINES_FOUND = (
    ("names.py", 1, "DEPRECATED_NAME_SUFFIX"), ("made.py", 1, "GENERATED_BANNER_PRESENT"), ("app/db.sql", 1, "ALTER_TABLE_OUTSIDE_MIGRATION"), ("app/db.sql", 2, "DROP_TABLE_OUTSIDE_MIGRATION"),
    ("count.py", 1, "COMMENT_CONTRADICTS_LITERAL"), ("cache.py", 1, "CACHE_KEY_NO_TENANT"), ("send.go", 3, "CHANNEL_SEND_AFTER_CLOSE"), ("go.go", 1, "GOROUTINE_NO_SYNC"),
)

#: Of each tool: its output, in SQL over ``p`` (path), ``l`` (line), ``c`` (column) and ``m`` (message), and the finding's line, column, severity, code and message.
OUTPUTS = {
    "ruff": ("""'[{"filename":"' || p || '","location":{"row":' || l || ',"column":' || c || '},"fix":null,"code":"E1","message":"' || m || '"}]'""", ("l", "c", "'error'", "'E1'", "m")),
    "eslint": ("""'[{"filePath":"' || p || '","messages":[{"line":' || l || ',"column":' || c || ',"severity":2,"ruleId":"r","message":"' || m || '"}]}]'""", ("l", "c", "'error'", "'r'", "m")),
    "hadolint": ("""'[{"file":"' || p || '","line":' || l || ',"column":' || c || ',"level":"info","code":"DL1","message":"' || m || '"}]'""", ("l", "c", "'info'", "'DL1'", "m")),
    "sqlfluff": ("""'[{"filepath":"' || p || '","violations":[{"line_no":' || l || ',"line_pos":' || c || ',"code":"L1","description":"' || m || '"}]}]'""", ("l", "c", "'warning'", "'L1'", "m")),
    "gitleaks": ("""'[{"File":"' || p || '","StartLine":' || l || ',"StartColumn":' || c || ',"RuleID":"g","Description":"' || m || '"}]'""", ("l", "c", "'error'", "'g'", "m")),
    "semgrep": ("""'{"results":[{"path":"' || p || '","start":{"line":' || l || ',"col":' || c || '},"check_id":"s","extra":{"severity":"ERROR","message":"' || m || '"}}]}'""", ("l", "c", "'error'", "'s'", "m")),
    "bandit": ("""'{"results":[{"filename":"' || p || '","line_number":' || l || ',"col_offset":' || c || ',"issue_severity":"HIGH","test_id":"B1","issue_text":"' || m || '"}]}'""", ("l", "c", "'error'", "'B1'", "m")),
    "markdownlint": ("""'[{"fileName":"' || p || '","lineNumber":' || l || ',"ruleNames":["MD1","x"],"ruleDescription":"' || m || '"}]'""", ("l", "0", "'warning'", "'MD1,x'", "m")),
    "govulncheck": ("""'{"config":{}}\n{"finding":{"osv":"GO-1","trace":[{"function":"f","module":"' || m || '","position":{"filename":"' || p || '","line":' || l || ',"column":' || c || '}}]}}'""", ("l", "c", "'error'", "'GO-1'", "'f via ' || m")),
    "clippy": ("""'{"reason":"build-finished"}\n{"reason":"compiler-message","message":{"level":"warning","message":"' || m || '","code":{"code":"k"},"spans":[{"file_name":"' || p || '","line_start":' || l || ',"column_start":' || c || '}]}}'""", ("l", "c", "'warning'", "'k'", "m")),
    "mypy": ("""p || ':' || l || ':' || c || ': error: ' || m || '  [misc]\nFound 1 error'""", ("l", "c", "'error'", "'misc'", "m")),
    "codespell": ("""p || ':' || l || ': ' || m""", ("l", "0", "'nit'", "'typo'", "m")),
    "govet": ("""'# pkg\n' || p || ':' || l || ':' || c || ': ' || m""", ("l", "c", "'error'", "'vet'", "m")),
}
ROW = "'src/f' || n_nationkey || '.go' AS p, n_nationkey + 1 AS l, n_regionkey + 2 AS c, n_name AS m"

VARIABLE = "upper(replace(n_name, ' ', '_'))"
ENVIRONMENT = {
    0: (".env", f"'# K_IGNORED=1\n\nexport ' || {VARIABLE} || '=1\nlower=2'"),
    1: (".env.example", f"{VARIABLE} || ' = 1'"),
    2: ("docker-compose.yml", f"'services:\n  a:\n    environment:\n      - ' || {VARIABLE} || '=1\n      other: 2\n    image: NOT_THIS'"),
    3: ("compose.yaml", f"'x:\n  environment:\n    ' || {VARIABLE} || ': 1\n  ports:\n    NOR_THIS: 1'"),
}


def _files(spark, d, samples: dict[str, str]) -> DataFrame:
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.lit(t).alias("content")) for p, t in samples.items()])).alias("x")
    return table(spark, d, "nation").select("n_nationkey", each).select(F.concat(F.col("n_nationkey").cast("string"), F.lit("/"), "x.p").alias("path"), "x.content")


def _sites(found: DataFrame, codes: tuple | None = None) -> DataFrame:
    rows = found if codes is None else found.where(F.col("code").isin(*{c for _, _, c in codes}))
    return rows.select("path", F.col("line").cast("int").alias("line"), "code")


def python_rules(spark, d):
    return _sites(syntax.all_python(_files(spark, d, PYTHON)))


def script_rules(spark, d):
    return _sites(scripts.all_scripts(_files(spark, d, SCRIPTS)))


def line_rules(spark, d):
    """Rules on lines, all but those on hardcoded values, which other queries hold."""
    return _sites(rules.all_rules(_files(spark, d, LINES)).where("category != 'hardcoded_config'"))


def linter_findings(spark, d):
    rows = table(spark, d, "nation").selectExpr(*ROW.split(", "))
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("tool"), F.expr(made.replace("\n", "\\n")).alias("stdout")) for t, (made, _) in OUTPUTS.items()])).alias("x")
    return linters.normalised(rows.select(each).select("x.tool", "x.stdout", F.lit("").alias("stderr")))


def _environment(spark, d) -> tuple[DataFrame, DataFrame]:
    nation = table(spark, d, "nation")
    path, content = (F.coalesce(*[F.when(F.col("n_regionkey") == r, F.expr(x)) for r, x in of.items()]) for of in ({r: f"'{v[0]}'" for r, v in ENVIRONMENT.items()}, {r: v[1].replace("\n", "\\n") for r, v in ENVIRONMENT.items()}))
    declared = nation.where(F.col("n_regionkey").isin(*ENVIRONMENT)).select(F.concat(F.lit("d"), F.col("n_nationkey").cast("string"), F.lit("/"), path).alias("path"), content.alias("content"))
    code = F.expr(f"'import os\\nos.getenv(\"' || {VARIABLE} || '\")\\nprocess.env.HOME_OF_ALL'")
    used = nation.where("n_nationkey % 3 > 0").select(F.concat(F.lit("s"), F.col("n_nationkey").cast("string"), F.lit("/a.py")).alias("path"), code.alias("content"))
    return declared, used


def environment_drift(spark, d):
    declared, used = _environment(spark, d)
    return environment.drift_of(declared.unionByName(used))


def environment_drift_of_changes(spark, d):
    declared, used = _environment(spark, d)
    files = declared.unionByName(used)
    return environment.drift_of(files, files.where("path LIKE 's1%'"))


def queries() -> dict:
    return {f.__name__: f for f in (python_rules, script_rules, line_rules, linter_findings, environment_drift, environment_drift_of_changes)}


def _expected(found: tuple) -> str:
    values = ", ".join(f"('{p}', {n}, '{c}')" for p, n, c in found)
    return f"SELECT n_nationkey || '/' || p AS path, line, code FROM nation, (VALUES {values}) v(p, line, code)"


def _drift_sql(changed: str, whole: bool) -> str:
    first = {0: 3, 1: 1, 2: 4, 3: 3}
    sql = f"""WITH n AS (SELECT *, {VARIABLE} AS name FROM nation),
d AS (SELECT name, 'd' || n_nationkey || '/' || CASE n_regionkey {' '.join(f"WHEN {r} THEN '{v[0]}'" for r, v in ENVIRONMENT.items())} END AS path,
  CASE n_regionkey {' '.join(f'WHEN {r} THEN {k}' for r, k in first.items())} END AS line FROM n WHERE n_regionkey < 4),
r AS (SELECT name, 's' || n_nationkey || '/a.py' AS path, 2 AS line FROM n WHERE n_nationkey % 3 > 0 UNION ALL SELECT 'HOME_OF_ALL', 's' || n_nationkey || '/a.py', 3 FROM n WHERE n_nationkey % 3 > 0),
c AS (SELECT * FROM r WHERE {changed})
SELECT min(path) AS path, min(line)::INT AS line, 'warning' AS severity, 'env_var_drift' AS category, 'USED_IN_CODE_NOT_DOCUMENTED' AS code,
  'Env var ''' || name || ''' referenced in code but not declared in any .env* / compose env block' AS message FROM c WHERE name NOT IN (SELECT name FROM d) GROUP BY name"""
    return sql if not whole else sql + """ UNION ALL
SELECT path, line::INT, 'nit', 'env_var_drift', 'DOCUMENTED_NOT_USED', 'Env var ''' || name || ''' declared in ' || path || ' but never referenced from code' FROM d WHERE name NOT IN (SELECT name FROM c)"""


def oracle_sql() -> dict[str, str]:
    parts = [f"SELECT '{t}' AS tool, p AS path, ({a})::INT AS line, ({b})::INT AS \"column\", {s} AS severity, {c} AS code, {m} AS message FROM n" for t, (_, (a, b, s, c, m)) in OUTPUTS.items()]
    return {
        "python_rules": _expected(PYTHON_FOUND),
        "script_rules": _expected(SCRIPTS_FOUND),
        "line_rules": _expected(LINES_FOUND),
        "linter_findings": f"WITH n AS (SELECT {ROW} FROM nation) " + " UNION ALL ".join(parts),
        "environment_drift": _drift_sql("true", True),
        "environment_drift_of_changes": _drift_sql("path LIKE 's1%'", False),
    }
