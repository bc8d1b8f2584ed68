"""Reports that are whole or not there, and a source that takes filters."""

import json

import pytest
from pyspark.sql import functions as F

from siftrock.operators import scenarios
from siftrock.sinks import reports
from siftrock.sources import repo


def listed(folder):
    return sorted(str(p.relative_to(folder)) for p in folder.rglob("*") if p.is_file())


def test_reports(spark, tmp_path):
    rows = [("a.txt", 2, "c"), ("a.txt", 1, "b\n"), ("sub/b.md", 5, "é"), ("a.txt", 3, None)]
    df = spark.createDataFrame(rows, reports.SCHEMA)
    reports.save(df, str(tmp_path))
    assert listed(tmp_path) == ["a.txt", "sub/b.md"] and (tmp_path / "a.txt").read_text() == "b\nc" and (tmp_path / "sub/b.md").read_text() == "é"
    with pytest.raises(Exception, match="already"):
        reports.save(df, str(tmp_path))
    reports.save(df.where("place > 1"), str(tmp_path), mode="overwrite")
    assert (tmp_path / "a.txt").read_text() == "c" and listed(tmp_path) == ["a.txt", "sub/b.md"]
    reports.save(df.limit(0), str(tmp_path))
    assert listed(tmp_path) == ["a.txt", "sub/b.md"]


def test_a_failed_task_leaves_no_report(spark, tmp_path):
    rows = spark.range(64, numPartitions=8).select(F.concat(F.lit("r"), (F.col("id") % 8).cast("string")).alias("report"), F.col("id").alias("place"), F.when(F.col("id") == 63, F.raise_error(F.lit("odd"))).otherwise("x").alias("text"))
    with pytest.raises(Exception, match="odd"):
        reports.save(rows, str(tmp_path))
    assert listed(tmp_path) == []
    for name in ("../x", "/x", ""):
        with pytest.raises(Exception, match="no name"):
            reports.save(spark.createDataFrame([(name, 1, "x"), ("good", 1, "x")], reports.SCHEMA), str(tmp_path))
    assert listed(tmp_path) == []
    reports.register(spark)
    with pytest.raises(Exception, match="several tasks"):
        spark.createDataFrame([("a", i, "x") for i in range(8)], reports.SCHEMA).repartition(4, "place").write.format("reports").mode("append").save(str(tmp_path))
    assert listed(tmp_path) == []


def test_scenarios_as_json(spark, tmp_path):
    points = [(r, "iac_terraform", "terraform_resource", "b.tf", n, f"aws.é{n}", None, {"k": 'v"\n'}) for r in ("one", "two") for n in range(1, 1 + 3 * (r == "one"))]
    points = spark.createDataFrame(points, "repo string, type_origin string, kind string, file string, line int, symbol string, docstring string, metadata map<string,string>")
    items = scenarios.scenarios(points, by=["repo"])
    head = spark.createDataFrame([("one",), ("two",)], "repo string").select("repo", F.struct(F.lit("v1").alias("$schema"), F.struct(F.col("repo").alias("root"), F.array(F.lit(0.89)).alias("of")).alias("codebase"), F.lit(None).cast("string").alias("none")).alias("head"))
    value = F.struct("id", "type_origin", "family", "title", "entry_point", "actor_role", "stimulus", "intended_behaviour", "failure_modes_to_test")
    pieces = reports.json_list(items, ["repo"], "place", value, F.concat("repo", F.lit("-scenarios.json")), head, "scenarios")
    reports.save(pieces, str(tmp_path))
    for r, n in (("one", 18), ("two", 0)):
        text = (tmp_path / f"{r}-scenarios.json").read_text()
        whole = json.loads(text)
        assert text == json.dumps(whole, indent=2) + "\n" and list(whole) == ["$schema", "codebase", "none", "scenarios"] and len(whole["scenarios"]) == n
        assert [s["id"] for s in whole["scenarios"]] == [f"SCEN-{i:04d}" for i in range(1, n + 1)]
    first = json.loads((tmp_path / "one-scenarios.json").read_text())["scenarios"][0]
    assert list(first["entry_point"]) == ["kind", "file", "line", "symbol", "metadata"] and first["stimulus"]["value"] == {"entry_point": "aws.é1", "metadata": {"k": 'v"\n'}}


def test_findings_as_json(spark, tmp_path):
    rows = [("one", "t", "b", "f", 2, "nit", "X", 'say "é"'), ("one", "t", "a", "g", 1, "error", "Y", "m"), ("one", "t", "b", "f", 1, "nit", "X", "n")]
    findings = spark.createDataFrame(rows, "repo string, tool string, category string, file string, line int, severity string, code string, message string")
    sets = spark.createDataFrame([(r, "v1", "now", f"/{r}") for r in ("one", "none")], "repo string, schema_version string, timestamp string, repo_root string")
    reports.save(reports.findings_json(findings, sets, ["repo"], F.concat("repo", F.lit(".json"))), str(tmp_path))
    names = ("tool", "category", "file", "line", "severity", "code", "message")
    listed_ = [dict(zip(names, r[1:])) for r in sorted(rows, key=lambda r: (r[2], r[3], r[4]))]
    for r, some, counts in (("one", listed_, {"a": 1, "b": 2}), ("none", [], {})):
        whole = {"schema_version": "v1", "timestamp": "now", "repo_root": f"/{r}", "total_findings": len(some), "by_category": counts, "findings": some}
        assert (tmp_path / f"{r}.json").read_text() == json.dumps(whole, indent=2, sort_keys=True) + "\n"


def test_scenarios_as_markdown(spark, tmp_path):
    points = [("one", "cli_go", "x", "b.go", n, "run", None, {}) for n in (2, 1)]
    points = spark.createDataFrame(points, "repo string, type_origin string, kind string, file string, line int, symbol string, docstring string, metadata map<string,string>")
    types = "array<struct<type: string, confidence: double, evidence: array<string>>>"
    sets = spark.createDataFrame([("one", "v1", "now", "/one", ["go"], [("cli_go", 0.9, ["**/main.go: main.go", "x"])]), ("none", "v1", "now", "/none", [], [])], f"repo string, schema string, timestamp string, root string, languages array<string>, types {types}")
    reports.save(reports.scenarios_markdown(scenarios.scenarios(points, by=["repo"]), sets, ["repo"], F.concat("repo", F.lit(".md"))), str(tmp_path))
    assert (tmp_path / "none.md").read_text() == "# Scenarios — now\n\n**Schema:** `v1`\n**Codebase root:** `/none`\n**Languages:** (none detected)\n\n## Detected software types\n\n(no types detected)\n\n## Scenarios (0)\n\n"
    text = (tmp_path / "one.md").read_text()
    assert "**Languages:** go\n" in text and "|---|---|---|\n| `cli_go` | 0.90 | `**/main.go: main.go` |\n\n## Scenarios (12)\n\n### `cli_go` × `adversarial_input` (2)\n\n| id | entry | title |\n|---|---|---|\n| `SCEN-0001` | b.go:1 `run` | run rejects adversarial input |\n" in text
    assert text.count("\n### ") == 6 and text.endswith(" |\n\n") and [x.split("`")[1] for x in text.splitlines() if x.startswith("| `SCEN")][:2] == ["SCEN-0001", "SCEN-0007"]


@pytest.fixture
def tree(tmp_path):
    for name in (".env", "z.py", "a/b/c.py", "a/d.js", "b/e.py", "b/node_modules/f.py", "c/g.go"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(name)
    return tmp_path


def test_source_filters_and_caps(spark, tree):
    repo.register(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        load = lambda **o: spark.read.format("repo").option("path", str(tree)).option("pushFilters", "true").options(**o).load()
        everything = [".env", "z.py", "a/d.js", "a/b/c.py", "b/e.py", "c/g.go"]
        assert [r.path for r in load().orderBy("file_ordinal").collect()] == everything
        assert [r.path for r in load(maxFiles=3).orderBy("file_ordinal").collect()] == everything[:3]
        assert load(maxFiles=0).count() == 0 and load(pushFilters="false").where("suffix = '.py'").count() == 3
        for condition, paths in (
            ("suffix = '.py'", ["a/b/c.py", "b/e.py", "z.py"]), ("path LIKE 'a/%'", ["a/b/c.py", "a/d.js"]), ("name IN ('e.py', 'g.go')", ["b/e.py", "c/g.go"]), ("path = 'c/g.go'", ["c/g.go"]),
            ("suffix = '.py' AND path LIKE 'b/%' AND size > 1", ["b/e.py"]), ("suffix = '.py' AND suffix = '.go'", []),
        ):
            assert sorted(r.path for r in load().where(condition).collect()) == paths, condition
        reader = repo.FilteringReader({"path": str(tree)})
        from pyspark.sql.datasource import EqualTo, GreaterThan, StringStartsWith

        left = list(reader.pushFilters([StringStartsWith(("path",), "a/b"), GreaterThan(("size",), 1), EqualTo(("suffix",), ".py")]))
        assert [type(f) for f in left] == [GreaterThan] and [p.value[2] for p in reader.partitions()] == ["", "a"]  # no task for other folders
        assert list(reader.walk("a")) == ["a/b/c.py"]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
