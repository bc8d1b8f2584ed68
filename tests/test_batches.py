"""Rows dealt over tasks and gathered into batches, and what is read by several rules found once."""

import pyarrow as pa
import pytest

from siftrock.functions import batches
from siftrock.operators import dependencies, nesting, scripts, syntax
from siftrock.plans import catalogue
from siftrock.sources.tables import table

DATA = "/root/testdata/sf0.001"


def test_rows_are_gathered():
    rows = [(f"f{i}", i) for i in range(2 * batches.ROWS + 1)]
    got = list(batches.gathered(iter(rows), (pa.string(), pa.int32()), ["path", "n"]))
    assert [b.num_rows for b in got] == [batches.ROWS, batches.ROWS, 1]
    assert [tuple(r.values()) for b in got for r in b.to_pylist()] == rows
    assert list(batches.gathered(iter([]), (pa.string(),), ["path"])) == []


def test_short_rows_of_one_file_are_dealt_over_tasks(spark):
    part = table(spark, DATA, "part")
    got = batches.spread(part)
    assert part.rdd.getNumPartitions() == 1 and got.rdd.getNumPartitions() == 4
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, part.collect()))


@pytest.mark.parametrize("name", ["line_rule_sites", "function_measures", "go_loop_queries", "board_pins", "repository_domains", "specialists"])
def test_long_work_begins_on_all_tasks(spark, name):
    assert "Repartition 4, true" in catalogue.queries()[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()


def test_files_are_parsed_once(spark):
    files = spark.createDataFrame([(f"a{i}.py", "import os\ntry:\n    f()\nexcept: pass\n") for i in range(3)] + [("pyproject.toml", '[project]\ndependencies = ["x"]\n')], "path string, content string")
    for found in (syntax.all_python(files), dependencies.dependency_drift(files, syntax.python_facts(files.where("path LIKE '%.py'"))), scripts.all_scripts(files.selectExpr("path || '.js' AS path", "content")), nesting.script_blocks(files)):
        assert "MapInArrow" not in found._jdf.queryExecution().optimizedPlan().toString()
