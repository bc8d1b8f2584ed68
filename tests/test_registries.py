"""Registries of types, domains and families on small sets of files, and the automaton and globs beneath them."""

import json

import pytest
from pyspark.sql import functions as F

from siftrock.operators import domains, linters, matching, scenarios, software, subsets


def files(spark, rows):
    return spark.createDataFrame(rows, "path string, content string")


def test_globs_and_texts():
    p = matching.Paths(["**/go.mod", "**/*.c", "**/STM32*.ld", "kernel/**", "**/*.tree-sitter", "Kconfig", "**/sys/dev/**/*.c"])
    assert p.of("go.mod") == [0] and p.of("a/go.mod") == [0] and p.of("a/x.go.mod") == [] and p.of("a/.c") == [1]
    assert p.of("kernel/x.c") == [1, 3] and p.of("a/kernel/x") == [] and p.of("b/STM32F4.ld") == [2] and p.of("x.tree-sitter") == [4]
    assert p.of("Kconfig") == [5] and p.of("a/Kconfig") == [] and p.of("sys/dev/a/b.c") == [1, 6] and p.of("") == []
    t = matching.Texts([("ab", "bc"), ("abc",), ("re:^x\\d", "zz"), ("re:q+",)])
    assert t.of([0, 1, 2, 3], "abc") == [0, 1] and t.of([2], "x1") == [2] and t.of([0, 2], "azz") == [2] and t.of([3], "") == [] and t.of([1], "ab") == []


def test_conflicts_need_the_whole_list(spark):
    rows = [("pyproject.toml", "[project.scripts]\ntorch"), ("setup.py", "console_scripts"), ("requirements.txt", "torch"), ("prefect.yaml", "")]
    assert {r.type for r in software.detected_types(files(spark, rows)).collect()} == {"cli_python", "data_pipeline_prefect", "ml_training"}
    rows = [("pyproject.toml", "torch"), ("requirements.txt", "jax"), ("dbt_project.yml", "")]
    assert {r.type for r in software.detected_types(files(spark, rows)).collect()} == {"library_python", "data_pipeline_dbt"}  # a library is tried before what it yields to


def test_types_of_each_set(spark):
    df = spark.createDataFrame([("a", "x/main.tf", ""), ("b", "Makefile", "obj-m := x"), ("b", "Kbuild", "obj-m"), ("c", "y.txt", None)], "repo string, path string, content string")
    got = {(r.repo, r.type) for r in software.detected_types(df, by=["repo"]).collect()}
    assert got == {("a", "iac_terraform"), ("b", "library_c"), ("b", "linux_kernel_module"), ("c", "unknown_software")}
    assert software.detected_types(df.limit(0), by=["repo"]).count() == 0


def test_domains(spark):
    rows = [
        ("app/X.xcodeproj/project.pbxproj", ""), ("Package.swift", "x"), ("s/v.swift", "import  UIKit"), ("auto_translations/a", ""), ("i/translations/b/c.txt", ""),
        ("pyproject.toml", "Django>=4 FLASK"), ("src/a.py", "tenant_id"), ("src/b.py", "org_id"), ("migrations/1.sql", ""), ("a.ex", "jwt.sign"),
    ]
    got = {r.domain: r for r in domains.detect(files(spark, rows)).collect()}
    assert len(got) == 16
    assert got["ios_native"].evidence == ["manifest-path: Package.swift", "manifest-path: app/X.xcodeproj/project.pbxproj", "file: Package.swift", "file: s/v.swift", "src: s/v.swift :: import  UIKit"]
    assert got["i18n"].evidence == ["file: i/translations/b/c.txt"]
    assert got["rest_api"].evidence == ["manifest-dep: pyproject.toml contains 'flask'"] and got["sql_migrations"].evidence == ["manifest-path: migrations/1.sql", "manifest-dep: pyproject.toml contains 'django>='"]
    assert not got["multi_tenant"].detected and len(got["multi_tenant"].evidence) == 2  # three files are needed
    assert not got["jwt"].detected and not got["elixir_phoenix"].detected  # one file isn't a language
    fires = {r.specialist for r in domains.called(domains.detect(files(spark, rows))).collect() if r.fires}
    assert fires == {"api_design_reviewer", "ios_reviewer", "i18n_reviewer"}


def test_empty_names_and_many_paths(spark):
    assert domains.detect(files(spark, [])).where("detected").count() == 0
    rows = [(f"d/{i:02d}.sql", None) for i in range(30)] * 2 + [(None, "x")]
    got = domains.detect(files(spark, rows)).where("domain = 'sql_migrations'").first()
    assert got.evidence == [f"manifest-path: d/{i:02d}.sql" for i in range(10)]


def test_families_of_types(spark):
    got = {}
    for r in scenarios.bridge(spark).collect():
        got.setdefault(r.type, set()).add(r.family)
    assert len(got) == 77 and len({f for some in got.values() for f in some}) == 34
    assert got["unknown_software"] == {"happy_path", "resource_limits", "dependency_compromise"} and got["iac_terraform"] == got["unknown_software"] | {"partial_failure", "persistence_corruption", "upgrade_migration"}
    sizes = {"cli_go": 6, "cli_node": 6, "cli_python": 6, "data_pipeline_dbt": 9, "fpga_vhdl": 6, "game_unity": 6, "iac_docker_compose": 6, "iac_helm": 6, "library_c": 8, "library_node": 5, "library_python": 5, "library_rust": 5, "message_queue_consumer": 7, "ml_training": 8, "webgl_three": 4}
    assert {t: len(got[t]) for t in sizes} == sizes
    assert "user_input_event" not in got["game_engine"] and "user_input_event" in got["game_godot"] and "dma_race" in got["bsd_kernel"]
    assert "protocol_replay" not in got["webgl_three"] and "backpressure" in got["websocket_server"]


POINTS = "type_origin string, kind string, file string, line int, symbol string, docstring string, metadata map<string,string>"


def test_scenarios(spark):
    rows = [
        ("iac_terraform", "terraform_resource", "b.tf", 10, "aws.x", " Makes it.\n", {}), ("iac_terraform", "terraform_resource", "b.tf", 9, "aws.x", None, {}), ("iac_terraform", "terraform_resource", "b.tf", 9, "aws.x", None, {}),
        ("cli_go", "cli_command", "a.go", 1, "run", None, {"command": "go run"}), ("nothing_known", "x", "a", 1, "y", None, {}),
    ]
    got = scenarios.scenarios(spark.createDataFrame(rows, POINTS)).orderBy("place").collect()
    assert [r.id for r in got] == [f"SCEN-{i:04d}" for i in range(1, len(got) + 1)]
    assert [(r.type_origin, r.entry_point.line) for r in got] == [("cli_go", 1)] * 6 + [("iac_terraform", 9)] * 6 + [("iac_terraform", 10)] * 6
    assert {r.title for r in got if r.family == "happy_path"} == {"Happy path of go run", "Happy path of aws.x"}
    assert {r.intended_behaviour for r in got if r.entry_point.line == 10} == {"Makes it."}
    assert scenarios.scenarios(spark.createDataFrame([], POINTS)).count() == 0


def test_places_in_bytes(spark):
    said = [
        json.dumps({"diagnostics": [{"category": "lint/x", "severity": "ERROR", "description": "d", "location": {"path": {"file": "a.js"}, "span": span}} for span in ([0, 1], [5, 6], [7, 9], [-3, 1], [99, 100])]}),
        json.dumps({"diagnostics": [{"location": {"path": {"file": "none.js"}}}, {"location": {"path": {"file": "b.js"}}}, {}]}), "", "no json", "[]", '{"diagnostics": null}',
    ]
    out = spark.createDataFrame([("biome", s, "") for s in said], "tool string, stdout string, stderr string")
    got = linters.normalised(out, files(spark, [("a.js", "é\né\nx"), ("b.js", None)])).collect()
    assert sorted((r.path, r.line, r.column) for r in got) == [("", 0, 0), ("a.js", 0, 0), ("a.js", 1, 1), ("a.js", 2, 3), ("a.js", 3, 2), ("a.js", 3, 94), ("b.js", 1, 1), ("none.js", 0, 0)]
    assert {r.severity for r in got} == {"error", "warning"}


def test_subsets(spark, tmp_path):
    df = files(spark, [(p, "") for p in ("a.py", "b/c.py", "docs/x.md", "b/i.PNG", "doc.py")])
    lines = spark.createDataFrame([(x,) for x in ("", " # no", "#", "./a.py ", "b/../b/c.py", "../a.py", "/a.py", "b/../../a.py", "gone.py", "a.py")], "value string")
    assert sorted(r.path for r in subsets.subset(df, lines).collect()) == ["a.py", "b/c.py"]
    assert sorted(r.path for r in subsets.whole(df).collect()) == ["a.py", "b/c.py", "doc.py"]
    for text, good in (('{"domains": {"a": {"detected": true}}}', True), ('{"other": 1}', False), ("{", False)):
        (tmp_path / "g.json").write_text(text)
        rows = subsets.gate(spark, str(tmp_path / "g.json"), "domains", "map<string, struct<detected: boolean>>")
        if good:
            assert rows.select(F.explode("domains").alias("k", "v")).first().k == "a"
        else:
            with pytest.raises(Exception, match="no document"):
                rows.collect()
