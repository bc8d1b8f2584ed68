"""Rules, joins, linters and the source tree on small hand-written inputs, by their full rows."""

import json

from pyspark.sql import functions as F

from siftrock.functions import text
from siftrock.operators import classify, findings, joins, linters, python_ast, rules
from siftrock.sources import repo


def files(spark, **contents):
    return spark.createDataFrame([(k.replace("__", "."), v) for k, v in contents.items()] or [("", None)], "path string, content string")


def found(df):
    return sorted((r.path, r.line, r.code) for r in df.collect())


def test_lines_end_as_in_python(spark):
    texts = ["", "a", "a\n", "a\r\nb", "a\x0bb\x85c\u2028d", "\n\n", None]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "path string, content string")
    got = {}
    for r in text.lines(df).orderBy("path", "line_no").collect():
        got.setdefault(int(r.path), []).append(r.line)
    assert got == {i: t.splitlines() for i, t in enumerate(texts) if t and t.splitlines()}


def test_hardcoded_takes_the_first_kind_that_holds(spark):
    lines = ["u = 'https://a.io/x' # 999", "h = '999.1.1.1 port: 8081'", "h = '10.0.0.7'", "p = '/etc/app/conf'", "p = '/tmp/app/conf 1500'", "port: 70000", "n = 200 + 1024", "# 12345", "x = 'localhost 5555'", "n = 0100 and 0101"]
    got = rules.hardcoded(files(spark, a__py="\n".join(lines)))
    assert [(r.line, r.code, r.message) for r in got.orderBy("line").collect()] == [
        (1, "HARDCODED_URL", "URL literal `https://a.io/x`"),
        (2, "HARDCODED_PORT", "port literal `8081`"),
        (3, "HARDCODED_IP", "IPv4 literal `10.0.0.7`"),
        (4, "HARDCODED_PATH", "Absolute path literal `/etc/app/conf`"),
        (5, "MAGIC_NUMBER", "magic number `1500`"),
        (6, "MAGIC_NUMBER", "magic number `70000`"),
        (10, "MAGIC_NUMBER", "magic number `101`"),
    ]


def test_context_reaches_two_lines(spark):
    query = "rows = q.filter_by(user_id=u)"
    df = files(spark, near=f"tenant_id = 1\n\n{query}", far=f"tenant_id = 1\n\n\n{query}", both=f"{query}\n{query}")
    assert found(rules.in_context(df, rules.TENANT_QUERIES)) == [("both", 1, "SQLALCHEMY_FILTER_BY"), ("both", 2, "SQLALCHEMY_FILTER_BY"), ("far", 4, "SQLALCHEMY_FILTER_BY")]


def test_other_rules(spark):
    df = files(
        spark,
        a__go="go run()\n\n\n\nclose(ch)\n// ch <- 1\nx()\nch <- 2\n",
        b__go="var wg sync.WaitGroup\ngo run()",
        c__py="if os.environ.get('ENV') != 'prod':\n    use = FakeThing\nTIMEOUT = 30  # wait 60 seconds\nRETRY = 3  # 3 times",
        d__sql="ALTER TABLE t ADD c INT;\n -- drop table x\n  drop table y;",
        e__txt="\n" * 49 + "@generated by x",
        f__txt="\n" * 50 + "@generated by x",
        g__py="load_old(thing_v2, load_old)",
    )
    assert [f for f in found(rules.all_rules(df)) if f[2] != "MAGIC_NUMBER"] == [
        ("a.go", 1, "GOROUTINE_NO_SYNC"),
        ("a.go", 8, "CHANNEL_SEND_AFTER_CLOSE"),
        ("c.py", 1, "MOCK_FALLBACK"),
        ("c.py", 3, "COMMENT_CONTRADICTS_LITERAL"),
        ("d.sql", 1, "ALTER_TABLE_OUTSIDE_MIGRATION"),
        ("d.sql", 3, "DROP_TABLE_OUTSIDE_MIGRATION"),
        ("e.txt", 1, "GENERATED_BANNER_PRESENT"),
        ("g.py", 1, "DEPRECATED_NAME_SUFFIX"),
        ("g.py", 1, "DEPRECATED_NAME_SUFFIX"),
    ]


def test_all_rules_read_files_four_times(spark):
    """Not once for each rule; what the quick looks let by is what the rules find."""
    df = files(spark, a__py="x = 1\x0b// DO NOT EDIT y", b__go="clo/* x */se(ch)\nch </* x */- 1\n", c__go="close(ch)\nch - 1", d__py="DO NOT EDIT", e__py=None)
    got = rules.all_rules(df)
    assert found(got) == [("a.py", 1, "GENERATED_BANNER_PRESENT"), ("b.go", 2, "CHANNEL_SEND_AFTER_CLOSE")]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") <= 4


def test_environment_drift(spark):
    df = files(spark, a__py="os.getenv('DB_URL') + os.environ['DB_URL']\nprocess.env.TOKEN\n$X", b__sh="echo ${DB_URL} $PORT")
    refs = rules.env_references(df)
    declared = spark.createDataFrame([("PORT",), ("SPARE_KEY",)], "name string")
    got = joins.undeclared(refs, declared, "name", ["path", "line_no"]).orderBy("name").collect()
    assert [tuple(r) for r in got] == [("DB_URL", "a.py", 1, 2), ("TOKEN", "a.py", 2, 1)]
    assert [r.name for r in joins.unused(declared, refs, "name").collect()] == ["SPARE_KEY"]


def test_findings(spark):
    rows = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x"), ("b", 5, "z"), ("a", 1, "w")], "k string, o int, v string")
    assert sorted(map(tuple, findings.keep_first(rows, ["k"], ["o"]).collect())) == [("a", 1, "w"), ("b", 5, "z")]
    ids = findings.sequential_ids(rows, ["k"], ["o", "v"]).orderBy("id").collect()
    assert [(r.id, r.k, r.v) for r in ids] == [("SCEN-0001", "a", "w"), ("SCEN-0002", "a", "x"), ("SCEN-0003", "a", "y"), ("SCEN-0004", "b", "z")]


def test_linters(spark):
    said = [
        ("ruff", json.dumps([{"filename": "a.py", "location": {"row": 3, "column": 1}, "fix": None, "code": "F401", "message": "m"}]), ""),
        ("eslint", json.dumps([{"filePath": "a.js", "messages": [{"line": 2, "column": 5, "severity": 2, "ruleId": None, "message": "m"}]}]), ""),
        ("semgrep", json.dumps({"results": [{"path": "s.py", "start": {"line": 7, "col": 2}, "check_id": "c", "extra": {"severity": "INVENTORY", "message": "m"}}]}), ""),
        ("markdownlint", json.dumps({"r.md": [{"lineNumber": 4, "ruleNames": ["MD1", "x"], "ruleDescription": "d"}]}), ""),
        ("markdownlint", json.dumps([{"fileName": "q.md", "lineNumber": 5, "ruleNames": ["MD2"], "ruleDescription": "d"}]), ""),
        ("clippy", '{"reason":"compiler-message","message":{"level":"help","message":"m","code":{"code":"c"},"spans":[{"file_name":"l.rs","line_start":9,"column_start":3}]}}\nnot json\n{"reason":"other"}', ""),
        ("govulncheck", '{"finding":{"osv":"GO-1","trace":[{"function":"f","module":"m","position":{"filename":"v.go","line":6,"column":1}}]}}\n{"config":{}}', ""),
        ("mypy", "m.py:8: error: bad thing  [arg]\nnonsense", ""),
        ("codespell", "t.md:2: teh ==> the", ""),
        ("govet", "", "w.go:1:2: odd"),
        ("bandit", "not json", ""),
        ("gitleaks", "", ""),
    ]
    got = linters.normalised(spark.createDataFrame(said, "tool string, stdout string, stderr string"))
    assert sorted(tuple(r)[:6] for r in got.collect()) == [
        ("clippy", "l.rs", 9, 3, "info", "c"),
        ("codespell", "t.md", 2, 0, "nit", "typo"),
        ("eslint", "a.js", 2, 5, "error", ""),
        ("govet", "w.go", 1, 2, "error", "vet"),
        ("govulncheck", "v.go", 6, 1, "error", "GO-1"),
        ("markdownlint", "q.md", 5, 0, "warning", "MD2"),
        ("markdownlint", "r.md", 4, 0, "warning", "MD1,x"),
        ("mypy", "m.py", 8, 0, "error", "arg"),
        ("ruff", "a.py", 3, 1, "error", "F401"),
        ("semgrep", "s.py", 7, 2, "info", "c"),
    ]


def test_names_and_globs(spark):
    df = spark.createDataFrame([("@s/p/x",), ("p/x",), ("a/b/c",)], "s string")
    assert [r[0] for r in df.select(text.package_root(F.col("s"))).collect()] == ["@s/p", "p", "a"]
    assert [r[0] for r in df.select(text.ancestors(F.col("s"))).collect()] == [["@s", "@s/p"], ["p"], ["a", "a/b"]]
    assert [r.lens for r in joins.with_globs(df, {"deep": ["**/x"], "flat": ["*/x"]}, "s").orderBy("s", "lens").collect()] == ["deep", "deep", "flat"]


def test_python_functions(spark):
    body = "def f(self, a, b, c):\n    for i in a:\n        if i:\n            while i and b:\n                pass\n"
    got = python_ast.complexity(files(spark, a__py=body, b__py="def (", c__py=None))
    assert found(got) == [("a.py", 1, "DEEP_NESTING"), ("a.py", 1, "TOO_MANY_PARAMS")]


def test_repository_source(spark, tmp_path):
    (tmp_path / ".git").mkdir()
    (tmp_path / ".git/x.py").write_text("no")
    (tmp_path / "sub").mkdir()
    for name, data in {".env": b"A=1", "b.py": b"", "sub/_c.py": b"ab\xffcd" * 3}.items():
        (tmp_path / name).write_bytes(data)
    repo.register(spark)
    got = spark.read.format("repo").option("path", str(tmp_path)).option("maxBytes", 6).load().orderBy("file_ordinal").collect()
    assert [(r.path, r.size, r.content) for r in got] == [(".env", 3, "A=1"), ("b.py", 0, ""), ("sub/_c.py", 15, "abcda")]


def test_languages(spark):
    df = files(spark, **{f"f{i}__py": "" for i in range(10)}, tsconfig__json="", main__go="", go__mod="")
    assert {r.lang: r.detected for r in classify.languages(df).collect()} == {"python": True, "typescript": False, "go": True}
