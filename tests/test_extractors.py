"""Extractors on small trees: what the queries' files don't hold."""

from siftrock.operators import extractors as x


def files(spark, rows, by=False):
    return spark.createDataFrame(rows, ("repo string, " if by else "") + "path string, content string")


def said(df):
    return sorted((r.file, r.line, r.symbol, r.docstring) for r in df.collect())


ALL = (x.package_exports, x.compose_services, x.chart_templates, x.dbt_models, x.board_ports, x.training_entries, x.queue_consumers, x.script_exports)


def test_nothing_and_nulls(spark):
    rows = [("p/__init__.py", None), ("p/a.py", None), ("compose.yml", None), ("c/templates/a.yaml", ""), ("models/a.sql", None), ("models/schema.yml", None), ("a.v", None), ("x.xdc", None)]
    for f in ALL:
        assert f(files(spark, [])).collect() == []
        assert said(f(files(spark, rows))) == ([("models/a.sql", 1, "model:a", "")] if f is x.dbt_models else [])


def test_nearest_package_of_each_set(spark):
    rows = [("r", "p/__init__.py", ""), ("r", "p/q/deep.py", "async def f():\n  'Says'\n"), ("r", "alone.py", "def g(): 0"), ("s", "p/q/deep.py", "class H: 0"), ("t", "__init__.py", ""), ("t", "top.py", "def t(): 0"), ("r", "p/tests/a.py", "def n(): 0")]
    got = x.package_exports(files(spark, rows, True), by=["repo"])
    assert sorted((r.repo, r.file, r.symbol, r.docstring) for r in got.collect()) == [("r", "p/q/deep.py", "f", "Says"), ("t", "top.py", "t", "")]


def test_the_last_literal_list_of_names_counts(spark):
    text = "__all__ = ['a']\n__all__: list = ('b', '_c')\n__all__ = [*x]\ndef a(): 0\ndef b(): 0\ndef _c(): 0\n"
    assert said(x.package_exports(files(spark, [("p/__init__.py", text)]))) == [("p/__init__.py", 5, "b", "")]


def test_yaml_entries():
    text = "a:\n  b: 1 # c\n  - d: x\n    e: 'y: z'\n# f: g\n---\nurl: http://h:1\n\tk : v\n"
    assert [(e[0], e[2], e[4], e[5], e[6]) for e in x.yaml_entries(text)] == [
        (0, 1, False, ["a"], ""), (0, 2, False, ["a", "b"], "1 # c"), (0, 3, True, ["a", "b", "d"], "x"), (0, 4, False, ["a", "b", "e"], "'y: z'"), (1, 7, False, ["url"], "http://h:1"), (1, 8, False, ["url", "k"], "v"),
    ]


def test_services_only_below_services(spark):
    text = "x-base:\n  not:\n    image: a\nservices:\n  web:\n    image: 'n:1' # c\n    build: ./b\n    image: last\n  # api:\n  db: {}\n  q:\n\nnetworks:\n  net:\n"
    got = x.compose_services(files(spark, [("docker-compose.yaml", text), ("tests/compose.yml", text), ("other.yml", text)]))
    assert said(got) == [("docker-compose.yaml", 5, "services.web", ""), ("docker-compose.yaml", 11, "services.q", "")]
    assert {r.symbol: r.metadata for r in got.collect()}["services.web"] == {"service": "web", "image": "last", "build": "./b"}


def test_models_and_their_folder(spark):
    schema = "models:\n  - name: a\n    description: 'Of a'\n    columns:\n      - name: id\n        description: no\n  - name: b\n    description: \"\"\n"
    rows = [("m/models/x/a.sql", "-- own\nselect"), ("m/models/x/b.sql", "-- own\nselect"), ("m/models/x/schema.yml", schema), ("m/models/y/a.sql", "\n--\nselect"), ("models/tests/a.sql", ""), ("a.sql", "")]
    assert said(x.dbt_models(files(spark, rows))) == [("m/models/x/a.sql", 2, "model:a", "Of a"), ("m/models/x/b.sql", 2, "model:b", "own"), ("m/models/y/a.sql", 3, "model:a", "")]


def test_votes_and_ties(spark):
    one = "module {}(input a, b, output [N-1:0] c);\nendmodule\nmodule none();\nendmodule\n"
    rows = [("b.v", one.format("m2")), ("a.v", one.format("m1")), ("c.v", "module m1(input z);\nendmodule"), ("tb/t.v", one.format("m0")), ("sub/x.xdc", "[get_ports a]")]
    got = x.board_ports(files(spark, rows)).collect()
    assert sorted((r.file, r.symbol, r.metadata["port_width_bits"], r.metadata.get("constraint_file")) for r in got) == [("a.v", "a", "1", None), ("a.v", "c", "-1", None)]  # each port of a header has its direction
    rows += [("z.lpf", 'LOCATE COMP "z" SITE "1";'), ("y.xdc", "# nothing"), ("zz.sdc", "[get_ports a]")]
    assert {r.symbol for r in x.board_ports(files(spark, rows + [("d.v", "module q(input z);\nendmodule")])).collect()} == {"z"}  # of two modules of a name the first counts


def test_training(spark):
    text = "@hydra.main(config_path='c')\ndef main(cfg):\n    'Starts.'\n    run(cfg)\n@hydra.main\nasync def bare(): 0\ndef step(m, o):\n    def inner(): o.step()\n    m.fit(1)\ndef _own(m): m.fit()\ndef fit(): fit()\nclass C:\n    def f(self): self.fit()\n"
    got = x.training_entries(files(spark, [("t/a.py", text), ("tests/a.py", text), ("b.py", "def f(m): m.fit"), ("c.py", "def f(: m.fit()")])).collect()
    assert sorted((r.file, r.line, r.symbol, r.docstring, r.metadata.get("signals"), r.metadata.get("entrypoint")) for r in got) == [
        ("t/a.py", 2, "main", "Starts.", None, "hydra.main"), ("t/a.py", 6, "bare", "", None, "hydra.main"), ("t/a.py", 7, "step", "", "fit,step", None),
    ]


def test_queues(spark):
    python = "c.subscribe(['a', 'b', x])\nc.subscribe(topic='k')\nx.y.subscribe('s')\nc.subscribe(z)\nch.basic_consume(queue='q', on_message_callback=cb)\nch.basic_consume(queue='q')\nch.basic_consume()\n"
    script = "// a.consume('no')\nch.consume('jobs', f); ch.consume('jobs', g)\nk.subscribe({ topics: ['t1', \"t2\"] })\n/* x\n*/ n.subscribe('s.*')\nk.run({ eachMessage: f })\n"
    got = x.queue_consumers(files(spark, [("a.py", python), ("b.ts", script), ("spec/b.ts", script), ("c.js", "d.consume ('x')"), ("b.go", script)])).collect()
    assert sorted((r.file, r.line, r.symbol) for r in got) == [
        ("a.py", 1, "c.subscribe:a"), ("a.py", 1, "c.subscribe:b"), ("a.py", 2, "c.subscribe:k"), ("a.py", 3, "consumer.subscribe:s"), ("a.py", 5, "cb"), ("a.py", 6, "ch.basic_consume:q"),
        ("b.ts", 2, "ch.consume:jobs"), ("b.ts", 3, "k.subscribe:t1"), ("b.ts", 3, "k.subscribe:t2"), ("b.ts", 5, "n.subscribe:s.*"), ("b.ts", 6, "k.run:eachMessage"),
    ]
    about = {r.symbol: r.metadata for r in got}
    assert about["cb"] == {"language": "python", "library": "pika", "binding": "ch", "api": "basic_consume", "queue": "q", "callback": "cb"} and about["n.subscribe:s.*"]["subject"] == "s.*"


def test_script_exports(spark):
    text = "export default class A {}\nexport async function f() {}\n export { a, b as c, _d, e as default } from './x'\nmodule.exports = { g, h: i }\nexports.j = 1; module.exports.k = 2\nmodule.exports._l = 3\nconst export_ = 1\nexport const a = 1, z = 2\n"
    got = x.script_exports(files(spark, [("src/a.tsx", text), ("dist/a.js", text), ("b.py", text), ("test.js", "module.exports = {}")])).collect()
    assert sorted((r.line, r.symbol, r.metadata["form"], r.metadata.get("declared_as")) for r in got) == [
        (1, "A", "esm_named", "class"), (2, "f", "esm_named", "function"), (3, "a", "esm_reexport", None), (3, "c", "esm_reexport", None), (4, "g", "cjs_object", None), (4, "h", "cjs_object", None), (4, "i", "cjs_object", None),
        (5, "j", "cjs_property", None), (8, "a", "esm_named", "const"),
    ]
    assert {r.metadata["language"] for r in got} == {"typescript"}
