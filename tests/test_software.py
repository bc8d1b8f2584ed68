"""Types of software on small sets of files."""

import pytest

from siftrock.operators import software

CASES = {
    "terraform": ({"main.tf": "x", "sub/b.tf": None, "terraform.tfvars": ""}, [("iac_terraform", 0.89, ["**/*.tf: main.tf", "**/terraform.tfvars: terraform.tfvars"])]),
    "service before library": ({"pyproject.toml": 'dependencies = ["fastapi"]', "app.py": "@app.get('/')", "p/__init__.py": "__all__ = []"}, [("web_service_python", 0.89, ["**/pyproject.toml: pyproject.toml", "**/*.py: app.py"])]),
    "library": ({"pyproject.toml": "", "p/__init__.py": "__all__ = []"}, [("library_python", 0.89, ["**/pyproject.toml: pyproject.toml", "**/__init__.py: p/__init__.py"])]),
    "two types": ({"package.json": '{"main": "x", "electron": "1"}', "Chart.yaml": "", "a.js": "BrowserWindow"}, [("desktop_electron", 0.89, ["**/package.json: package.json", "**/*.js: a.js"]), ("iac_helm", 0.85, ["**/Chart.yaml: Chart.yaml"]), ("library_node", 0.85, ["**/package.json: package.json"])]),
    "unity": ({"Assets/Scripts/P.cs": "class P : MonoBehaviour {}", "ProjectSettings/a.asset": ""}, [("game_unity", 0.89, ["**/ProjectSettings/*.asset: ProjectSettings/a.asset", "**/Assets/**/*.cs: Assets/Scripts/P.cs", "**/*.cs: Assets/Scripts/P.cs"])]),
    "unknown": ({"a.txt": "x"}, [("unknown_software", 0.85, [])]),
    "nothing": ({}, [("unknown_software", 0.85, [])]),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_types(spark, name):
    files, expected = CASES[name]
    got = software.detected_types(spark.createDataFrame(list(files.items()), "path string, content string"))
    assert sorted((r.type, r.confidence, r.evidence) for r in got.collect()) == expected
