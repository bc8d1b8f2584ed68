"""Entry points and changes on small sources, by their full rows."""

from siftrock.operators import changes, entry_points


def files(spark, contents):
    return spark.createDataFrame(list(contents.items()) or [("", None)], "path string, content string")


def test_known_types(spark):
    df = files(spark, {
        "main.tf": '\nresource "aws_s3_bucket" "data" {\n}\nmodule "vpc" {\n  source = "x"\n}\n',
        "src/lib.rs": "pub fn go() {}\n  pub fn hidden() {}\npub(crate) fn no() {}\npub async unsafe fn far() {}\n#[tauri::command]\nasync fn say(x: u8) {}\n",
        "m.ts": "ipcMain.handle('open', f)\nconst w = new BrowserWindow({})\napp.whenReady().then(go)\n",
        "r.go": '// r.GET("/no", f)\nr.GET("/a", f)\nmux.Get(`/b`, f)\nhttp.HandleFunc("/c", f)\n',
        "P.cs": "class Plain : Base {\n  void Start() {}\n}\nclass Hero : MonoBehaviour {\n  private void Start() {}\n  void Update() {}\n  void Other() {}\n}\n",
        "none.tf": None,
        "empty.rs": "",
        "x.txt": 'resource "a" "b" {',
    })
    got = sorted((r.path, r.line, r.kind, r.symbol) for r in entry_points.discover(df).collect())
    assert got == [
        ("P.cs", 5, "boot_path", "Hero.Start"),
        ("P.cs", 6, "main_function", "Hero.Update"),
        ("m.ts", 1, "ipc_handler", "open"),
        ("m.ts", 2, "boot_path", "BrowserWindow"),
        ("m.ts", 3, "boot_path", "app.ready"),
        ("main.tf", 1, "terraform_resource", "aws_s3_bucket.data"),
        ("main.tf", 4, "terraform_resource", "module.vpc"),
        ("r.go", 2, "http_route", "r.GET /a"),
        ("r.go", 3, "http_route", "mux.GET /b"),
        ("r.go", 4, "http_route", "http.HandleFunc /c"),
        ("src/lib.rs", 1, "library_export", "go"),
        ("src/lib.rs", 4, "library_export", "far"),
        ("src/lib.rs", 5, "ipc_handler", "say"),
    ]


def test_unknown_software_takes_the_first_rule(spark):
    df = files(spark, {"a.py": "def main():\n    pass\ndef other(): pass\ndef _p(): pass\nif __name__ == '__main__':\n    main()\n", "b.go": "func main() {}\nfunc Show() {}\n", "c.py": " " * 40000 + "\ndef late(): pass"})
    got = entry_points.ranked(entry_points.discover_unknown(df)).orderBy("rank").collect()
    assert [(r.path, r.line, r.kind, r.symbol) for r in got] == [
        ("a.py", 1, "main_function", "main"),
        ("a.py", 3, "library_export", "other"),
        ("a.py", 5, "main_function", "__main__"),
        ("b.go", 1, "main_function", "main"),
        ("b.go", 2, "library_export", "Show"),
    ]


DIFF = """diff --git a/m.py b/m.py
--- a/m.py
+++ b/m.py\t2020
@@ -1,3 +10,6 @@ def x
 old
-gone
+@dataclass(frozen=True)
+class Data:
+    class Inner:
+class Color(StrEnum):
+class _Hidden:
@@ -40 +50,2 @@
+class Later(Base):
diff --git a/t.ts b/t.ts
--- a/t.ts
+++ b/t.ts
@@ -0,0 +1,2 @@
+export interface Shape {
+interface Local {
--- a/gone.py
+++ /dev/null
@@ -1 +0,0 @@
-class Gone:
"""


def test_new_types(spark):
    df = spark.createDataFrame([("d", DIFF), ("none", None), ("empty", "")], "diff_id string, content string")
    got = sorted((r.file, r.line, r.kind, r.name, r.language) for r in changes.new_types(df).collect())
    assert got == [("m.py", 12, "dataclass", "Data", "python"), ("m.py", 14, "enum", "Color", "python"), ("m.py", 50, "class", "Later", "python"), ("t.ts", 1, "interface", "Shape", "typescript")]


def test_unaccompanied(spark):
    bare = {"api/openapi.yaml": "x", ".github/workflows/a.yml": "x", "Dockerfile": "", "a.py": None}
    codes = lambda contents: sorted(r.code for r in changes.unaccompanied(files(spark, contents)).collect())
    assert codes(bare) == ["CI_NO_NOTES", "DOCKERFILE_NO_NOTES", "SCHEMA_NO_CODEGEN"]
    assert codes(bare | {"README.md": "x"}) == ["SCHEMA_NO_CODEGEN"]
    assert codes(bare | {"gen.py": "# @generated by x"}) == ["CI_NO_NOTES", "DOCKERFILE_NO_NOTES"]
    assert codes({}) == []
