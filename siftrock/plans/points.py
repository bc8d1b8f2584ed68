"""Queries of the extractors of entry points. Files are made from rows of ``part``, a repository for each brand or part; names, places, documentation and pins are
its columns, and the SQL derives the entry points from these."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftrock.functions.batches import spread
from siftrock.operators import extractors
from siftrock.sources.tables import table

OUT = ("repo", "kind", "file", "line", "symbol", "docstring")


def _made(spark, d, repo: str, path: str, content: str, where: str = "true") -> DataFrame:
    return spread(table(spark, d, "part").where(where)).select(F.expr(repo).cast("string").alias("repo"), F.expr(path).alias("path"), F.expr(content).alias("content"))


def _said(points: DataFrame) -> DataFrame:
    """The entry points with their metadata as one text, in the order of its keys."""
    entries = F.transform(F.array_sort(F.map_entries("metadata")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return points.select(*OUT, F.array_join(entries, ";").alias("metadata"))


def package_exports(spark, d):
    """Modules in packages, below them, beside them and in folders of tests; with ``__all__`` and without, with private names and broken code."""
    path = "CASE p_size % 4 WHEN 0 THEN 'pkg/m' WHEN 1 THEN 'pkg/sub/deep/m' WHEN 2 THEN 'scripts/m' ELSE 'pkg/tests/m' END || p_partkey || '.py'"
    listed = r"CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN '__all__ = [\"f' || p_partkey || '\"]\n' ELSE '__all__ = names()\n' END"
    body = r"'def f' || p_partkey || '():\n    \"\"\"\n    Does ' || p_name || '.\n    More.\n    \"\"\"\nclass _Own: pass\nclass C' || p_partkey || ': pass\n'"
    broken = r"CASE WHEN p_partkey % 13 = 0 THEN 'def (\n' ELSE '' END"
    modules = _made(spark, d, "p_brand", path, f"repeat('# x\\n', p_size % 5) || {listed} || {body} || {broken}")
    packages = table(spark, d, "part").where("p_brand != 'Brand#2'").select(F.col("p_brand").alias("repo"), F.lit("pkg/__init__.py").alias("path"), F.lit("def root(): pass\n").alias("content")).distinct()
    return _said(extractors.package_exports(modules.unionByName(packages), by=["repo"]))


PACKAGES = """WITH m AS (SELECT *, CASE p_size % 4 WHEN 0 THEN 'pkg/m' ELSE 'pkg/sub/deep/m' END || p_partkey || '.py' AS file, p_size % 5 + CASE WHEN p_partkey % 3 > 0 THEN 2 ELSE 1 END AS first FROM part
  WHERE p_size % 4 < 2 AND p_brand <> 'Brand#2' AND p_partkey % 13 > 0)
SELECT p_brand AS repo, 'library_export' AS kind, file, first::INT AS line, 'f' || p_partkey AS symbol, 'Does ' || p_name || '.' AS docstring,
  'in_all=' || (p_partkey % 3 = 1) || ';language=python;scope=module' AS metadata FROM m
UNION ALL SELECT p_brand, 'library_export', file, (first + 6)::INT, 'C' || p_partkey, '', 'in_all=false;language=python;scope=module' FROM m WHERE p_partkey % 3 <> 1
UNION ALL SELECT DISTINCT p_brand, 'library_export', 'pkg/__init__.py', 1, 'root', '', 'in_all=false;language=python;scope=package' FROM part WHERE p_brand <> 'Brand#2'"""


def model_tasks(spark, d):
    """Models whose documentation is in the schema of their folder, in their first comment, or nowhere; and SQL that is no model."""
    place = "CASE WHEN p_partkey % 7 = 0 THEN 'macros/' ELSE 'models/' END || p_type || '/m' || p_partkey || '.sql'"
    code = r"CASE p_size % 3 WHEN 0 THEN '\n-- About ' || p_name || '\n' WHEN 1 THEN '\n\n' ELSE 'select 0\n-- late\n' END || repeat('-- x\n', p_size % 4) || 'select 1\n'"
    models = _made(spark, d, "p_brand", place, code)
    entry = r"'  - name: m' || p_partkey || '\n    columns:\n      - id\n    description: \"All of ' || p_name || '\"\n'"
    schema = table(spark, d, "part").where("p_size % 2 = 0").select("p_brand", "p_type", "p_partkey", F.expr(entry).alias("e"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", "e"))), lambda x: x["e"])
    schema = schema.groupBy("p_brand", "p_type").agg(F.concat(F.lit("version: 2\nmodels:\n"), F.array_join(listed, "")).alias("content"))
    schema = schema.select(F.col("p_brand").alias("repo"), F.concat(F.lit("models/"), "p_type", F.lit("/schema.yml")).alias("path"), "content")
    return _said(extractors.dbt_models(models.unionByName(schema), by=["repo"]))


MODELS = """SELECT p_brand AS repo, 'dag_task' AS kind, 'models/' || p_type || '/m' || p_partkey || '.sql' AS file, CASE p_size % 3 WHEN 2 THEN 1 ELSE 3 + p_size % 4 END::INT AS line,
  'model:m' || p_partkey AS symbol, CASE WHEN p_size % 2 = 0 THEN 'All of ' || p_name WHEN p_size % 3 = 0 THEN 'About ' || p_name WHEN p_size % 3 = 1 AND p_size % 4 > 0 THEN 'x' ELSE '' END AS docstring,
  'framework=dbt;kind=model;model=m' || p_partkey || CASE WHEN p_size % 2 = 0 THEN ';source=models/' || p_type || '/schema.yml:#models/m' || p_partkey ELSE '' END AS metadata
FROM part WHERE p_partkey % 7 > 0"""


def service_points(spark, d):
    """Services of one compose file for each brand, a service for each of its parts."""
    entry = r"'  s' || p_partkey || ':  # one\n    image: ' || CASE WHEN p_size % 2 = 0 THEN '\"' || p_name || ':1\"' ELSE p_name END || ' # two\n    environment:\n      - A=1\n      image: no\n' || repeat('    ports:\n', p_size % 3)"
    rows = table(spark, d, "part").select("p_brand", "p_partkey", F.expr(entry).alias("e"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", "e"))), lambda x: x["e"])
    files = rows.groupBy("p_brand").agg(F.concat(F.lit("version: '3'\nservices:\n"), F.array_join(listed, ""), F.lit("volumes:\n  data:\n")).alias("content"))
    return _said(extractors.compose_services(files.select(F.col("p_brand").alias("repo"), F.lit("deploy/compose.yml").alias("path"), "content"), by=["repo"]))


SERVICES = """SELECT p_brand AS repo, 'terraform_resource' AS kind, 'deploy/compose.yml' AS file,
  (3 + coalesce(sum(5 + p_size % 3) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INT AS line, 'services.s' || p_partkey AS symbol, '' AS docstring,
  'image=' || p_name || CASE WHEN p_size % 2 = 0 THEN ':1' ELSE '' END || ';service=s' || p_partkey AS metadata FROM part"""


def template_points(spark, d):
    """Templates of charts: documents with and without a kind, a name or a folder of templates."""
    path = "CASE p_partkey % 4 WHEN 0 THEN 'chart/templates/a' WHEN 1 THEN 'chart/charts/sub/templates/a' WHEN 2 THEN 'chart/values' ELSE 'templates/deep/a' END || p_partkey || '.yaml'"
    first = r"repeat('# x\n', p_size % 4) || 'apiVersion: apps/v1\nkind: Deployment\nmetadata:\n  labels:\n    app: y\n  name: ' || replace(p_name, ' ', '-') || '\n'"
    second = r"CASE p_size % 3 WHEN 0 THEN '---\nkind: Job\nspec:\n  name: no\n' WHEN 1 THEN '---\nmetadata:\n  name: only\n' ELSE '' END"
    return _said(extractors.chart_templates(_made(spark, d, "p_brand", path, f"{first} || {second}"), by=["repo"]))


TEMPLATES = """WITH t AS (SELECT *, CASE p_partkey % 4 WHEN 0 THEN 'chart/templates/a' ELSE 'templates/deep/a' END || p_partkey || '.yaml' AS file FROM part WHERE p_partkey % 4 IN (0, 3))
SELECT p_brand AS repo, 'helm_template' AS kind, file, 1 AS line, 'Deployment/' || replace(p_name, ' ', '-') AS symbol, '' AS docstring,
  'apiVersion=apps/v1;kind=Deployment;name=' || replace(p_name, ' ', '-') || ';template_path=' || substr(file, strpos(file, 'templates')) AS metadata FROM t
UNION ALL SELECT p_brand, 'helm_template', file, (8 + p_size % 4)::INT, 'Job', '', 'apiVersion=;kind=Job;name=;template_path=' || substr(file, strpos(file, 'templates')) FROM t WHERE p_size % 3 = 0"""


def board_pins(spark, d):
    """A board for each part: one module has p_size % 5 + 1 ports, the other p_size % 3 + 1; pins vote for one of them, or for none."""
    port = lambda name, n, style: f"array_join(transform(sequence(1, int({n})), i -> '{style}' || '{name}' || i), {{}})"
    one = r"'// input no\nmodule wide #(parameter N = 2) (\n' || " + port("a", "p_size % 5 + 1", "  input wire [7:0] ").format(r"',\n'") + r" || '\n);\nendmodule\n'"
    two = r"'module slim (' || " + port("b", "p_size % 3 + 1", "").format("', '") + r" || ');\n  output reg ' || " + port("b", "p_size % 3 + 1", "").format("', '") + r" || ';\nendmodule\n'"
    pins = r"CASE p_partkey % 4 WHEN 0 THEN 'set_property PACKAGE_PIN A1 [get_ports {b1}]\n' WHEN 1 THEN 'LOCATE COMP \"a1[0]\" SITE \"x\";\n' WHEN 2 THEN '[get_ports other]\n' ELSE '# none\n' END"
    files = _made(spark, d, "p_partkey", "'rtl/w.v'", one).unionByName(_made(spark, d, "p_partkey", "'rtl/s.sv'", two)).unionByName(_made(spark, d, "p_partkey", "'constraints/x.xdc'", pins)).unionByName(_made(spark, d, "p_partkey", "'lib/z.v'", one))
    return _said(extractors.board_ports(files, by=["repo"]))


BOARDS = """WITH n AS (SELECT *, p_size % 5 + 1 AS wide, p_size % 3 + 1 AS slim FROM part),
t AS (SELECT *, CASE p_partkey % 4 WHEN 0 THEN 'slim' WHEN 1 THEN 'wide' ELSE CASE WHEN wide > slim THEN 'wide' ELSE 'slim' END END AS top FROM n),
u AS (SELECT *, unnest(range(1, CASE top WHEN 'wide' THEN wide ELSE slim END + 1)) AS i FROM t)
SELECT p_partkey::VARCHAR AS repo, 'fpga_toplevel_port' AS kind, CASE top WHEN 'wide' THEN 'rtl/w.v' ELSE 'rtl/s.sv' END AS file, CASE top WHEN 'wide' THEN 2 + i ELSE 2 END::INT AS line,
  CASE top WHEN 'wide' THEN 'a' ELSE 'b' END || i AS symbol, '' AS docstring,
  CASE WHEN p_partkey % 4 < 3 THEN 'constraint_file=constraints/x.xdc;' ELSE '' END || 'module=' || top || ';port_direction=' || CASE top WHEN 'wide' THEN 'input' ELSE 'output' END || ';port_width_bits=' || CASE top WHEN 'wide' THEN '8' ELSE '1' END AS metadata FROM u"""


def training_points(spark, d):
    """Functions that train by p_size % 3 + 1 calls, that are started with a configuration, that do neither, or that are private."""
    head = r"CASE p_partkey % 4 WHEN 0 THEN '@hydra.main(config_path=None)\n' WHEN 1 THEN '@other.main\n' ELSE '' END"
    name = "CASE WHEN p_partkey % 5 = 0 THEN '_f' ELSE 'f' END || p_partkey"
    body = r"repeat('    # .fit(\n', p_size % 3) || CASE p_partkey % 3 WHEN 0 THEN '    loss.backward()\n    opt.step()\n' WHEN 1 THEN '    def inner():\n        model.fit(x)\n' ELSE '    fit(train)\n' END"
    return _said(extractors.training_entries(_made(spark, d, "p_brand", "'src/t' || p_partkey || '.py'", f"{head} || 'def ' || {name} || r'(model):\n    \"Trains ' || p_name || '.\"\n' || {body}".replace("r'(model)", "'(model)")), by=["repo"]))


TRAINING = """SELECT p_brand AS repo, 'main_function' AS kind, 'src/t' || p_partkey || '.py' AS file, CASE WHEN p_partkey % 4 < 2 THEN 2 ELSE 1 END::INT AS line, 'f' || p_partkey AS symbol, 'Trains ' || p_name || '.' AS docstring,
  CASE WHEN p_partkey % 4 = 0 THEN 'entrypoint=hydra.main;' ELSE '' END || 'framework=ml' || CASE p_partkey % 3 WHEN 0 THEN ';signals=backward,step' WHEN 1 THEN ';signals=fit' ELSE '' END AS metadata
FROM part WHERE p_partkey % 5 > 0 AND (p_partkey % 4 = 0 OR p_partkey % 3 < 2)"""


def consumer_points(spark, d):
    """Subscriptions in Python and scripts, under names and on lines of parts, some of them in comments."""
    python = r"repeat('# c.subscribe(1)\n', p_size % 4) || CASE p_partkey % 3 WHEN 0 THEN 'c' || p_partkey || '.subscribe([\"' || p_type || '\", \"x\"])\n' WHEN 1 THEN 'ch.basic_consume(queue=\"' || p_type || '\")\n' ELSE 'c.subscribe(topics)\n' END"
    script = r"repeat('// a.consume(1)\n', p_size % 4) || CASE p_partkey % 4 WHEN 0 THEN 'ch.consume(\"' || p_type || '\", f)\n' WHEN 1 THEN '/* ch.consume(\"' || p_type || '\") */\n' WHEN 2 THEN 'k.subscribe({topic: \"' || p_type || '\"})\n' ELSE 'nc.subscribe(\"' || p_type || '\", g)\n' END"
    files = _made(spark, d, "p_brand", "'a' || p_partkey || '.py'", python).unionByName(_made(spark, d, "p_brand", "'s/b' || p_partkey || '.ts'", script))
    return _said(extractors.queue_consumers(files, by=["repo"]))


CONSUMERS = """WITH p AS (SELECT *, unnest(CASE p_partkey % 3 WHEN 0 THEN [p_type, 'x'] WHEN 1 THEN [p_type] ELSE [] END) AS t FROM part)
SELECT p_brand AS repo, 'mq_consumer' AS kind, 'a' || p_partkey || '.py' AS file, (1 + p_size % 4)::INT AS line, CASE p_partkey % 3 WHEN 0 THEN 'c' || p_partkey || '.subscribe:' ELSE 'ch.basic_consume:' END || t AS symbol, '' AS docstring,
  CASE p_partkey % 3 WHEN 0 THEN 'api=subscribe;binding=c' || p_partkey || ';language=python;library=kafka-python;topic=' ELSE 'api=basic_consume;binding=ch;language=python;library=pika;queue=' END || t AS metadata FROM p
UNION ALL SELECT p_brand, 'mq_consumer', 's/b' || p_partkey || '.ts', (1 + p_size % 4)::INT, CASE p_partkey % 4 WHEN 0 THEN 'ch.consume:' WHEN 2 THEN 'k.subscribe:' ELSE 'nc.subscribe:' END || p_type, '',
  CASE p_partkey % 4 WHEN 0 THEN 'api=consume;binding=ch;language=javascript;library=amqplib;queue=' WHEN 2 THEN 'api=subscribe;binding=k;language=javascript;library=kafkajs;topic=' ELSE 'api=subscribe;binding=nc;language=javascript;library=nats_or_redis;subject=' END || p_type
FROM part WHERE p_partkey % 4 <> 1"""


def script_points(spark, d):
    """Exports in each form, under names of parts and on lines of theirs; private ones, and those of folders of tests."""
    name = "CASE WHEN p_partkey % 6 = 0 THEN '_n' ELSE 'n' END || p_partkey"
    said = rf"CASE p_partkey % 5 WHEN 0 THEN 'export class ' || {name} || ' {{}}\n' WHEN 1 THEN 'export {{ x as ' || {name} || ', y }} from \"z\"\n' WHEN 2 THEN 'module.exports = {{ ' || {name} || ' }}\n' WHEN 3 THEN 'exports.' || {name} || ' = 1\n' ELSE 'const ' || {name} || ' = 1\n' END"
    path = "CASE p_size % 3 WHEN 0 THEN 'src/a' ELSE 'b' END || p_partkey || CASE p_size % 2 WHEN 0 THEN '.ts' ELSE '.cjs' END"
    files = _made(spark, d, "p_brand", path, rf"repeat('f()\n', p_size) || {said}").unionByName(_made(spark, d, "p_brand", "'spec/' || p_partkey || '.js'", said))
    return _said(extractors.script_exports(files, by=["repo"]))


EXPORTS = """WITH p AS (SELECT *, CASE p_size % 3 WHEN 0 THEN 'src/a' ELSE 'b' END || p_partkey || CASE p_size % 2 WHEN 0 THEN '.ts' ELSE '.cjs' END AS file, CASE p_size % 2 WHEN 0 THEN 'typescript' ELSE 'javascript' END AS language FROM part WHERE p_partkey % 5 < 4)
SELECT p_brand AS repo, 'library_export' AS kind, file, (p_size + 1)::INT AS line, 'n' || p_partkey AS symbol, '' AS docstring,
  CASE p_partkey % 5 WHEN 0 THEN 'declared_as=class;form=esm_named' WHEN 1 THEN 'form=esm_reexport' WHEN 2 THEN 'form=cjs_object' ELSE 'form=cjs_property' END || ';language=' || language AS metadata FROM p WHERE p_partkey % 6 > 0
UNION ALL SELECT p_brand, 'library_export', file, (p_size + 1)::INT, 'y', '', 'form=esm_reexport;language=' || language FROM p WHERE p_partkey % 5 = 1"""


def queries() -> dict:
    return {f.__name__: f for f in (package_exports, model_tasks, service_points, template_points, board_pins, training_points, consumer_points, script_points)}


def oracle_sql() -> dict[str, str]:
    return {"package_exports": PACKAGES, "model_tasks": MODELS, "service_points": SERVICES, "template_points": TEMPLATES, "board_pins": BOARDS, "training_points": TRAINING, "consumer_points": CONSUMERS, "script_points": EXPORTS}
