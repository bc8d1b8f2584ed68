"""Queries that hold every rule on Python, scripts and lines against files built from rows of ``part``: which rule a row is for, whether it is broken or kept, on which line and under which
name are its columns, and the SQL derives from these what must be found. Rules other than a file's own may fire in it too; they aren't asked for here."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftrock.functions.batches import spread
from siftrock.operators import changes, dependencies, rules, scripts, syntax
from siftrock.plans.structured import made
from siftrock.sources.tables import table

TRY = "try:\n    f()\nexcept {}:\n    {}\n"
DOC = 'def §(a, b):\n    """Adds two numbers to one sum.\n\n    Args:\n        a (int): the first one of them\n        {}: the other one\n    """\n    return a + b\n'
#: Of each rule: code, name of the file, what breaks it and what keeps it (§: the name, ¤: the number), and the line of the finding in it; 0: always the file's first.
PYTHON = (
    ("SILENT_BARE", "a.py", TRY.format("", "log(§)").replace(" :", ":"), TRY.format("KeyError", "log(§)"), 3),
    ("BROAD_CATCH", "a.py", TRY.format("Exception", "x = §"), TRY.format("KeyError", "x = §"), 3),
    ("SILENT_EMPTY", "a.py", TRY.format("§", "pass"), TRY.format("§", "x = 1"), 3),
    ("SILENT_LOG_ONLY", "a.py", TRY.format("§", "logger.error(1)"), TRY.format("§", "raise"), 3),
    ("TODO_IN_HANDLER", "a.py", TRY.format("KeyError", "x = 1  # TODO §\n    y = 2"), TRY.format("KeyError", "x = 1  # for §\n    y = 2"), 3),
    ("DETACHED_CREATE_TASK", "a.py", "async def §():\n    asyncio.create_task(g())\n", "async def §():\n    t = asyncio.create_task(g())\n", 2),
    ("LOOP_RUN_IN_EXECUTOR_NO_AWAIT", "a.py", "async def §():\n    loop.run_in_executor(None, g)\n", "async def §():\n    await loop.run_in_executor(None, g)\n", 2),
    ("N_PLUS_ONE_LOOP", "a.py", "for i in §:\n    db.query(i)\n", "for i in §:\n    f(i)\ndb.query(1)\n", 2),
    ("SQL_INJECTION_FSTRING", "a.py", 'db.execute(f"select {§}")\n', 'db.execute("select ?", §)\n', 1),
    ("LARGE_FILE_FULL_READ", "a.py", 'open("¤.csv").read()\n', 'open("¤.txt").read()\n', 1),
    ("UNUSED_IMPORT", "a.py", "import §\n", "import §\n§.f()\n", 1),
    ("ORPHAN_MODULE_DEF", "a.py", "def §(): f()\n", "def §(): f()\n§()\n", 1),
    ("RECURSIVE_NO_MEMO", "a.py", "def §(n):\n    return §(n - 1)\n", "@functools.lru_cache(None)\ndef §(n):\n    return §(n - 1)\n", 1),
    ("UNREACHABLE", "a.py", "def §(n):\n    return 1\n    f()\n", "def §(n):\n    f()\n    return 1\n", 3),
    ("NO_ASSERTION_TEST", "test_a.py", "def test_§(): f()\n", "def test_§():\n    assert f()\n", 1),
    ("ASSERT_TRUE_LITERAL", "test_a.py", "def test_§():\n    assert True\n", "def test_§():\n    assert f()\n", 2),
    ("MOCK_REPLACES_SUT_HEURISTIC", "test_a.py", 'from § import g\n@patch("§.g")\ndef test_x(): assert g()\n', 'from other import g\n@patch("§.g")\ndef test_x(): assert g()\n', 2),
    ("EMPTY_DOWNGRADE", "migrations/a.py", "def upgrade(): §()\ndef downgrade(): pass\n", "def upgrade(): §()\ndef downgrade(): §()\n", 2),
    ("MISSING_DOWNGRADE", "migrations/a.py", "def upgrade(): §()\n", "def upgrade(): §()\ndef downgrade(): §()\n", 0),
    ("TRIVIAL_DOCSTRING", "a.py", 'def §():\n    """Does it."""\n', 'def §():\n    """Counts all the rows that are left."""\n', 1),
    ("DOCSTRING_PARAM_MISSING", "a.py", DOC.format("a"), DOC.format("b"), 1),
    ("DOCSTRING_PARAM_GHOST", "a.py", DOC.format("c"), DOC.format("b"), 1),
)
SCRIPTS = (
    ("CATCH_EMPTY", "a.js", "try { §() } catch (e) { }\n", "try { §() } catch (e) { throw e }\n", 1),
    ("CATCH_CONSOLE_ONLY", "a.ts", "try { §() } catch (e) { console.error(e); }\n", "try { §() } catch (e) { console.error(e); throw e }\n", 1),
    ("OPTIONAL_CHAIN_FALLIBLE", "a.tsx", "const § = r?.json()\n", "const § = r.json()\n", 1),
    ("FLOATING_PROMISE", "a.mjs", "fetch('/§')\n", "await fetch('/§')\n", 1),
    ("PROMISE_NO_CATCH", "a.js", "x = Promise.all(§)\n", "x = Promise.all(§).catch(f)\n", 1),
    ("JS_EXPECT_TRUE", "a.test.js", "expect('§').toBe('§')\n", "expect('§').toBe('x')\n", 1),
    ("JS_EXPECT_TRUTHY", "a.spec.ts", "expect('§').toBeTruthy()\n", "expect(§).toBeTruthy()\n", 1),
    ("JS_SYNC_FILE_READ", "a.js", "fs.readFileSync('¤.txt')\n", "fs.readFile('¤.txt', f)\n", 1),
    ("JS_LARGE_FILE_SYNC_READ", "a.js", "readFile('¤.csv', f)\n", "readFile('¤.txt', f)\n", 1),
)
LINES = (
    ("DEPRECATED_NAME_SUFFIX", "a.py", "§_v2 = f()\n", "§ = f()\n", 1),
    ("GENERATED_BANNER_PRESENT", "a.py", "# Code generated by §\n", "# Code written by §\n", 0),
    ("ALTER_TABLE_OUTSIDE_MIGRATION", "a.sql", "alter table § add c int;\n", "select * from §;\n", 1),
    ("DROP_TABLE_OUTSIDE_MIGRATION", "a.sql", "  DROP TABLE §;\n", "-- DROP TABLE §\n", 1),
    ("COMMENT_CONTRADICTS_LITERAL", "a.py", "limit = 5  # at most 7 §\n", "limit = 5  # at most 5 §\n", 1),
    ("CACHE_KEY_NO_TENANT", "a.py", "cache.get(§)\n", "cache.get(tenant_id, §)\n", 1),
    ("GOROUTINE_NO_SYNC", "a.go", "go §()\n", "go §()\nwg.Wait()\n", 1),
    ("SQLALCHEMY_FILTER_BY", "a.py", "q.filter_by(user_id=§)\n", "q.filter_by(user_id=§, org_id=o)\n", 1),
    ("SQLALCHEMY_FILTER", "a.py", "q.filter(M.user_id == §)\n", "t = tenant_id\nq.filter(M.user_id == §)\n", 1),
    ("DJANGO_FILTER", "a.py", "M.objects.filter(user=§)\n", "M.objects.filter(name=§)\n", 1),
    ("KYSELY_WHERE", "a.ts", "q.where({ userId: § })\n", "q.where({ name: § })\n", 1),
    ("PRISMA_WHERE", "a.ts", "find({ where: { userId: § } })\n", "find({ where: { userId: §, orgId } })\n", 1),
    ("RAW_SQL_WHERE_USER", "a.sql", "SELECT 1 FROM t WHERE user_id = §\n", "SELECT 1 FROM t WHERE account_id = 2 AND user_id = §\n", 1),
    ("FN_SIG_NO_TENANT", "a.py", "def §(user_id):\n    f()\n", "def §(user_id):\n    f(workspace_id)\n", 1),
    ("MOCK_FALLBACK", "a.ts", "if (process.env.NODE_ENV !== 'production') {\n  return mock_(§)\n}\n".replace("mock_", "mock "), "if (process.env.NODE_ENV !== 'production') {\n  return §\n}\n", 1),
)


def _files(spark, d, some: tuple[tuple, ...]) -> DataFrame:
    """A file for each part: its rule's sample below p_size % 7 lines of comment, broken where p_size is even. Its folder is the rule's code."""
    s = spark.createDataFrame([(i, c, f, bad, good) for i, (c, f, bad, good, _) in enumerate(some)], "i int, code string, file string, bad string, good string")
    p = spread(table(spark, d, "part")).select("p_partkey", "p_size", (F.col("p_partkey") % len(some)).cast("int").alias("i"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("name"))
    rows = p.join(F.broadcast(s), "i")  # the samples of one registry, whatever the data
    sample = F.replace(F.when(F.col("p_size") % 2 == 0, F.col("bad")).otherwise(F.col("good")), F.lit("§"), F.col("name"))
    sample = F.replace(sample, F.lit("¤"), F.col("p_partkey").cast("string"))
    return rows.select(F.concat_ws("/", "code", F.col("p_partkey").cast("string"), "file").alias("path"), F.concat(F.expr("repeat('# x\\n', p_size % 7)"), sample).alias("content"))


def _own(found: DataFrame) -> DataFrame:
    return found.where(F.col("code") == F.substring_index("path", "/", 1)).select("path", F.col("line").cast("int").alias("line"), "code")


def _sql(some: tuple[tuple, ...]) -> str:
    values = ", ".join(f"({i}, '{c}', '{f}', {n})" for i, (c, f, _, _, n) in enumerate(some))
    return f"""SELECT code || '/' || p_partkey || '/' || file AS path, CASE WHEN n = 0 THEN 1 ELSE n + p_size % 7 END::INT AS line, code
FROM part JOIN (VALUES {values}) s(i, code, file, n) ON i = p_partkey % {len(some)} WHERE p_size % 2 = 0"""


def python_rule_sites(spark, d):
    return _own(syntax.all_python(_files(spark, d, PYTHON)))


def script_rule_sites(spark, d):
    return _own(scripts.all_scripts(_files(spark, d, SCRIPTS)))


def line_rule_sites(spark, d):
    """The rules on lines and those around them, for tenants too."""
    return _own(rules.all_rules(_files(spark, d, LINES)))


def dependency_sites(spark, d):
    """Packages named by sizes: those of multiples of three are declared, those of even sizes imported, by a module for each part."""
    modules = made(spark, d, "'src/' || p_partkey || '.py'", r"repeat('# x\n', int(p_partkey % 3)) || 'import lib' || p_size || '.sub, os\n'").where("content NOT RLIKE 'lib[0-9]*[13579][.]'")
    names = F.array_sort(F.collect_set(F.concat(F.lit("Lib"), F.col("p_size").cast("string"), F.lit(">=1"))))
    manifest = table(spark, d, "part").where("p_size % 3 = 0").agg(F.concat(F.lit("[project]\ndependencies = "), F.to_json(names), F.lit("\n")).alias("content"))
    files = modules.unionByName(manifest.select(F.lit("pyproject.toml").alias("path"), "content"))
    return dependencies.dependency_drift(files, syntax.python_facts(files.where("path LIKE '%.py'")))


DEPENDENCIES = """WITH i AS (SELECT 'src/' || p_partkey || '.py' AS path, (1 + p_partkey % 3)::INT AS line, p_size FROM part WHERE p_size % 2 = 0),
u AS (SELECT min({path: path, line: line}) AS s, count(*) AS n, p_size FROM i WHERE p_size % 3 > 0 GROUP BY p_size)
SELECT s.path AS path, s.line AS line, 'warning' AS severity, 'undeclared_dep' AS category, 'UNDECLARED_DEP' AS code, 'lib' || p_size || ': ' || n AS message FROM u
UNION ALL SELECT DISTINCT 'pyproject.toml', 1, 'nit', 'unused_dep', 'UNUSED_DEP', 'lib' || p_size FROM part WHERE p_size % 3 = 0 AND p_size % 2 > 0"""


def added_types(spark, d):
    """Types that diffs add: classes and dataclasses at the top of modules, by the hunk's start and the lines that are kept before them; removed and inner ones are none."""
    head = r"'--- a/m.py\n+++ b/src/' || p_type || '.py\n@@ -1,4 +' || p_size || ',9 @@\n' || repeat(' x\n', int(p_partkey % 4)) || '-class Old:\n'"
    body = r"CASE p_size % 3 WHEN 0 THEN '+@dataclass\n' ELSE '' END || '+class ' || initcap(replace(p_name, ' ', 'X')) || ':\n+    class Inner:\n+        pass\n'"
    diffs = made(spark, d, "p_partkey", f"{head} || {body}")
    return changes.new_types(diffs.withColumnRenamed("path", "diff_id"))


TYPES = """SELECT p_partkey AS diff_id, 'src/' || p_type || '.py' AS file, (p_size + p_partkey % 4 + CASE WHEN p_size % 3 = 0 THEN 1 ELSE 0 END)::INT AS line, CASE WHEN p_size % 3 = 0 THEN 'dataclass' ELSE 'class' END AS kind,
  upper(p_name[1]) || replace(substr(p_name, 2), ' ', 'x') AS name, 'python' AS language FROM part"""


def queries() -> dict:
    return {f.__name__: f for f in (python_rule_sites, script_rule_sites, line_rule_sites, dependency_sites, added_types)}


def oracle_sql() -> dict[str, str]:
    return {"python_rule_sites": _sql(PYTHON), "script_rule_sites": _sql(SCRIPTS), "line_rule_sites": _sql(LINES), "dependency_sites": DEPENDENCIES, "added_types": TYPES}
