"""The entry points, with and without the subpackage that may be taken away."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["category", "code", "n"]
    assert set(e.oracle_sql()) <= set(e.queries())


def test_the_rest_imports_alone():
    code = "import sys; sys.modules['siftrock.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not any(x.startswith('op') and x[2].isdigit() for x in q), q; assert 'pipeline' not in q"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT).returncode == 0


def test_nothing_else_imports_the_subpackage():
    for p in (ROOT / "siftrock").rglob("*.py"):
        if "llm" not in p.parts:
            assert "siftrock.llm" not in p.read_text()
