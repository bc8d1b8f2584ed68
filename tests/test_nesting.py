"""Rules on structure: states over lines, brackets, depths; every kind of node of the measures of functions."""

import pytest

from siftrock.operators import nesting, python_ast


def files(spark, **texts):
    return spark.createDataFrame([(k.replace("__", "."), v) for k, v in texts.items()], "path string, content string")


def found(df):
    return sorted((r.path, r.line, r.code) for r in df.collect())


@pytest.mark.parametrize("text, code", [
    ("a // b\nc", "a \nc"), ("a /* b\nc */ d", "a \n d"), ('x("a//b")', "x()"), ("x('a\\'b') y", "x() y"), ("`a\n// b` c", "\n c"),
    ("/*/ a */b", "b"), ('"a\\\nb" c', "\n c"), ("'open\nnever closed", "\n"), ("/* open\nnever", "\n"), ("a\r\n/* b\r\n*/c", "a\r\n\r\nc"), ('"a\\', ""), ("/**/x/***/y", "xy"), ("", ""),
])
def test_code_of(text, code):
    assert nesting.code_of(text) == code


def test_nulls_and_other_files(spark):
    df = files(spark, a__js=None, b__go="", c__txt="x = {}\nfor a {\ndb.Query(1)\n}\n", d__py=None, go="close(c)\nc <- 1")
    assert nesting.all_nesting(df).collect() == []
    assert nesting.all_nesting(spark.createDataFrame([], "path string, content string")).collect() == []


def test_brackets(spark):
    long = "\n" * 25
    df = files(
        spark,
        a__js="const u = 'http://x'; function f() {" + long + "}\nfunction g() { // }" + long + "\nvar k = async x => {" + long + "} }\n// let h = () => { }\n",
        b__spec__ts="test('a', () => { })\nit('b', () => { if (x) { expect(x) } })\nit('c', () => {\n",
        c__js="it('a', () => { })",
        d__js="for await (const r of rows) { for (;;) { db.query(r) } }\nwhile (x) y(); db.query(1)\nxs.map(function (x) {\n  prisma.user.x.find(x)\n",
    )
    assert found(nesting.script_blocks(df)) == [
        ("a.js", 1, "FN_TOO_LONG_REGEX"), ("a.js", 26, "FN_TOO_LONG_REGEX"), ("a.js", 52, "FN_TOO_LONG_REGEX"),
        ("b.spec.ts", 1, "JS_NO_ASSERTION"), ("d.js", 1, "JS_N_PLUS_ONE_LOOP"), ("d.js", 4, "JS_N_PLUS_ONE_LOOP"),
    ]


def test_depths_against_their_definition():
    import random
    import re

    def depth(some):
        return sum(x.count("{") - x.count("}") for x in some)

    def defined(text):
        each = text.splitlines()
        for i, x in enumerate(each):
            heads = [k for k in range(i + 1) if re.match(nesting.GO_LOOP, each[k])]
            call = re.search(nesting.GO_QUERY, x)
            if call and heads and depth(each[: heads[-1]]) >= 0 and all(depth(each[heads[-1] : k]) > 0 for k in range(heads[-1] + 1, i + 1)):
                yield i + 1, call[1]

    rng = random.Random(1)
    parts = ["for x {", "}", "db.Query(a)", "if y {", "} else {", "tx.Exec(b) {", "for db.Query(c) {", "}}", "z()", "for a { db.Exec(d) }"]
    for _ in range(3000):
        text = "\n".join(rng.choices(parts, k=rng.randint(1, 14)))
        assert list(nesting.looped_calls(text)) == list(defined(text)), text


@pytest.mark.parametrize("body, branches, depth", [
    ("if x: pass", 1, 1), ("for x in y: pass", 1, 1), ("async for x in y: pass", 1, 1), ("while x: pass", 1, 1), ("try: pass\n except A: pass\n except B: pass", 1, 1), ("try: pass\n except* A: pass", 1, 1),
    ("with x: pass", 1, 1), ("async with x: pass", 1, 1), ("match x:\n  case 1: pass\n  case _: pass", 1, 1), ("assert x", 0, 0), ("y = 1 if x else 2", 0, 0), ("y = a and b or c", 2, 0),
    ("y = [a for a in b if a if b]", 2, 0), ("class C:\n  if x: pass", 1, 1), ("def g():\n  if x: pass", 0, 0), ("y = lambda: a and b", 1, 0), ("if x:\n  if y:\n   if z: pass\n  elif w: pass", 4, 3),
])
def test_measures_of_each_node(body, branches, depth):
    ((_, name, _, params, b, d, documented),) = [m for m in python_ast.measures(f"async def f(a, *b, c=1, **d):\n {body}") if m[1] == "f"]
    assert (name, params, b, d, documented) == ("f", 4, branches, depth, False)


def test_defaults_and_decorators_count():
    assert next(python_ast.measures("@d(a or b)\ndef f(x=a and b): pass"))[4] == 2
