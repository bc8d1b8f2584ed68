"""Declarations of environment variables and drift, on the forms that declare and those that don't."""

from siftrock.operators import environment

FILES = [
    (".env", "A_B=1\n# C_D=1\n\n export E_F = 2\nlower=3\nNOEQUALS\nX=1\nLONG=2\r\nG_H=a=b"),
    ("a/compose.yml", "services:\n  web:\n    environment:\n      - P_A=1\n      - P_B\n\n      P_C: 2\n    image: NOT_A\n      NOT_B: 1\n  db:\n    environment:\n      P_D: x\nNOT_C: 1\n"),
    ("env.txt", "NOT_D=1"),
    ("none/.env", None),
    ("empty/.env.local", ""),
    ("m.py", 'os.getenv("A_B")\nos.environ["U_A"]\nos.environ["U_A"]\n'),
    ("n.js", "process.env.U_B + process.env.P_A"),
]


def test_declarations(spark):
    files = spark.createDataFrame(FILES, "path string, content string")
    got = {(r.path, r.line_no, r.name) for r in environment.declarations(files).collect()}
    assert got == {(".env", 1, "A_B"), (".env", 4, "E_F"), (".env", 8, "LONG"), (".env", 9, "G_H"), *(("a/compose.yml", n, v) for n, v in ((4, "P_A"), (5, "P_B"), (7, "P_C"), (12, "P_D")))}


def test_drift_of_a_tree_and_of_a_change(spark):
    files = spark.createDataFrame(FILES, "path string, content string")
    got = {(r.code, r.path, r.line) for r in environment.drift_of(files).collect()}
    used = {("USED_IN_CODE_NOT_DOCUMENTED", "m.py", 2), ("USED_IN_CODE_NOT_DOCUMENTED", "n.js", 1)}
    idle = {("DOCUMENTED_NOT_USED", p, n) for p, n in ((".env", 4), (".env", 8), (".env", 9), ("a/compose.yml", 5), ("a/compose.yml", 7), ("a/compose.yml", 12))}
    assert got == used | idle
    assert {(r.code, r.path, r.line) for r in environment.drift_of(files, files.where("path = 'm.py'")).collect()} == {("USED_IN_CODE_NOT_DOCUMENTED", "m.py", 2)}
    assert environment.drift_of(files.limit(0)).collect() == []
