"""Entry points that take more than a pattern: exports of Python packages, models with documentation elsewhere, services and templates in YAML, pins of boards.

``files`` has path, content and the columns ``by`` of a set of files, such as a repository. Each extractor gives by, type_origin, kind, file, line,
symbol, docstring and metadata (a map of texts), which ``scenarios`` takes. What a file holds is read where it lies, one row a fact; which facts
belong together is joins and aggregates on narrow rows.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_left
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from siftrock.functions.text import ancestors, line_array

# ---- fixed values: folders that are no part of what is looked for

COMMON = (".git", "node_modules", "__pycache__", "dist", "build", "target", "reports", "reports_dev", "docs_dev", "scripts_dev", "tests_dev")
CACHES = (".pytest_cache", ".mypy_cache", ".ruff_cache")
SAMPLES = ("samples_dev", "examples_dev")
PACKAGE_SKIPPED = (
    *COMMON, *CACHES, *SAMPLES, ".hg", ".svn", ".venv", "venv", "env", ".env", ".tox", "vendor", ".cache", "out", "bin", "obj", ".idea", ".vscode", "tests", "test", "_internal", "_private",
    "downloads_dev", "libs_dev", "builds_dev",
)
MODEL_SKIPPED = (*COMMON, *CACHES, *SAMPLES, ".hg", ".svn", ".cache", ".idea", ".vscode", "dbt_packages", "logs", "tests", "test", "snapshots", "macros", "seeds", "analyses")
COMPOSE_SKIPPED = (*COMMON, *CACHES, ".venv", "venv", "env", ".env", "tests", "test")
CHART_SKIPPED = (*COMPOSE_SKIPPED, "charts")
BOARD_SKIPPED = (*COMMON, ".hg", ".svn", "ipcore", "xilinx_ip", "altera_ip", "lib", "tb", "vendor", "out")
QUEUE_SKIPPED = (
    *COMMON, *CACHES, *SAMPLES, ".hg", ".svn", ".venv", "venv", "env", ".env", ".tox", ".pnpm-store", ".yarn", "vendor", ".cache", "out", ".next", ".nuxt", ".idea", ".vscode", "tests", "test", "__tests__", "spec", "coverage",
    "downloads_dev", "libs_dev", "builds_dev",
)
NODE_SUFFIXES = (".js", ".mjs", ".cjs", ".ts", ".tsx")
NODE_NAME = r"[A-Za-z_$][\w$]*"
#: Form and pattern; a list holds names, of which ``as`` gives the one that is public in the first of them.
NODE_EXPORTS = (
    ("esm_named", rf"(?m)^\s*export\s+(?:default\s+)?(?:async\s+)?(?P<declared>function|class|const|let|var)\s+(?P<name>{NODE_NAME})"),
    ("esm_reexport", r"(?m)^\s*export\s*\{(?P<list>[^}]*)\}"),
    ("cjs_object", r"(?m)^\s*module\.exports\s*=\s*\{(?P<list>[^}]*)\}"),
    ("cjs_property", rf"(?m)^\s*(?:module\.)?exports\.(?P<name>{NODE_NAME})\s*="),
)
NODE_SKIPPED = (*QUEUE_SKIPPED, ".turbo")
TRAINING = ("fit", "train", "step", "backward")
TRAINING_TEXT = r"fit\(|\.train\(|\.step\(|\.backward\(|hydra"
QUEUE_SUFFIXES = (".js", ".mjs", ".cjs", ".ts", ".tsx", ".jsx")
QUEUE_TEXT = r"consume\(|subscribe\(|\.run\(|kafkajs|amqplib|nats"
QUEUE_ON = r"(?P<binding>[A-Za-z_$][\w$]*)\s*\.\s*"
#: Library, api, what is named, pattern.
QUEUE_CALLS = (
    ("amqplib", "consume", "queue", QUEUE_ON + r"consume\s*\(\s*(?P<quote>['\"])(?P<named>[^'\"]+)(?P=quote)"),
    ("kafkajs", "subscribe", "topic", QUEUE_ON + r"subscribe\s*\(\s*\{\s*(?:topic|topics)\s*:\s*(?P<list>(?:['\"][^'\"]+['\"])|(?:\[[^\]]+\]))"),
    ("nats_or_redis", "subscribe", "subject", QUEUE_ON + r"subscribe\s*\(\s*(?P<quote>['\"])(?P<named>[^'\"]+)(?P=quote)"),
    ("kafkajs", "run_eachMessage", None, QUEUE_ON + r"run\s*\(\s*\{\s*eachMessage\s*:"),
)
COMPOSE_NAMES = ("docker-compose.yml", "docker-compose.yaml", "compose.yml", "compose.yaml")
SERVICE_KEYS = ("image", "build", "restart", "container_name", "hostname")
SERVICE_NAME = r"^[A-Za-z0-9][A-Za-z0-9_\-.]*$"
PIN_PORT = r"\[get_ports\s*\{?\s*([A-Za-z_]\w*)(?:\[[^\]]+\])?\s*\}?\s*\]"
PIN_PLACE = r'(?i)LOCATE\s+COMP\s+"([A-Za-z_]\w*)(?:\[[^\]]+\])?"'
PORT = r"\b(?P<dir>input|output|inout)\b(?:\s+(?:reg|wire|logic|signed|unsigned))*(?:\s*\[\s*(?P<hi>[^\]:]+)\s*:\s*(?P<lo>[^\]:]+)\s*\])?\s+(?P<names>[^,;)]+)"
OLD_PORT = r"(?m)^\s*(?P<dir>input|output|inout)\b(?:\s+(?:reg|wire|logic|signed|unsigned))*(?:\s*\[\s*(?P<hi>[^\]:]+)\s*:\s*(?P<lo>[^\]:]+)\s*\])?\s+(?P<names>[^;]+);"


def outside(path: Column, folders: Sequence[str]) -> Column:
    """Whether no part of a path is one of these names."""
    return ~F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, folders)))


def folder(path: Column) -> Column:
    """The folder of a path; empty at the top."""
    return F.when(path.contains("/"), F.regexp_replace(path, r"/[^/]*$", "")).otherwise(F.lit(""))


def _points(rows: DataFrame, by: Sequence[str], type_origin: str, kind: str, file: str, line: str, symbol: Column, docstring: Column, metadata: dict[str, Column]) -> DataFrame:
    pairs = [x for k, v in metadata.items() for x in (F.lit(k), v.cast("string"))]
    made = F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())
    return rows.select(
        *by, F.lit(type_origin).alias("type_origin"), F.lit(kind).alias("kind"), F.col(file).alias("file"), F.col(line).cast("int").alias("line"), symbol.alias("symbol"), F.coalesce(docstring, F.lit("")).alias("docstring"), made.alias("metadata")
    )


def _mapped(rows: DataFrame, by: Sequence[str], fields: Sequence[StructField], read) -> DataFrame:
    """by, path and ``fields`` for each tuple that ``read`` gives of a file's (path, content)."""
    rows = rows.select(*by, F.col("path").cast("string").alias("path"), "content")

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        for batch in batches:
            at, out = [], []
            for i, (path, text) in enumerate(zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True)):
                some = list(read(path, text or ""))
                at += [i] * len(some)
                out += some
            kept = batch.select([*by, "path"]).take(pa.array(at, pa.int64()))
            cols = list(zip(*out)) if out else [[]] * len(fields)
            yield pa.RecordBatch.from_arrays([*kept.columns, *(pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(cols, fields))], [*by, "path", *(f.name for f in fields)])

    return rows.mapInArrow(run, StructType([*rows.select(*by).schema.fields, StructField("path", StringType()), *fields]))


# ---- Python packages


def public_definitions(text: str):
    """(line, name, first line of the docstring, listed) of a module's public functions and classes; listed: whether ``__all__`` has it, null without one."""
    try:
        module = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return
    listed = None
    for at in module.body:
        targets = at.targets if isinstance(at, ast.Assign) else [at.target] if isinstance(at, ast.AnnAssign) else []
        if any(isinstance(t, ast.Name) and t.id == "__all__" for t in targets) and isinstance(at.value, (ast.List, ast.Tuple)):
            values = [v.value if isinstance(v, ast.Constant) else None for v in at.value.elts]
            listed = set(values) if all(isinstance(v, str) for v in values) else listed
    for at in module.body:
        if isinstance(at, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) and not at.name.startswith("_"):
            said = next((x.strip() for x in (ast.get_docstring(at) or "").splitlines() if x.strip()), "")
            yield at.lineno, at.name, said, None if listed is None else at.name in listed


def package_exports(files: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """Public functions and classes of the modules in packages, those of ``__all__`` where there is one. A module is in a package if any folder
    above it holds an ``__init__.py``: a semi-join of its ancestors with these folders."""
    mine = files.where(F.col("path").endswith(".py") & outside(F.col("path"), PACKAGE_SKIPPED))
    init = F.substring_index("path", "/", -1) == "__init__.py"
    packages = files.where(init).select(*by, folder(F.col("path")).alias("above")).distinct()
    above = mine.select(*by, "path", F.explode(F.concat(F.array(F.lit("")), ancestors(F.col("path")))).alias("above"))
    inside = above.join(packages, [*by, "above"], "left_semi").select(*by, "path").distinct()
    fields = [StructField("line", IntegerType()), StructField("name", StringType()), StructField("said", StringType()), StructField("listed", BooleanType())]
    found = _mapped(mine, by, fields, lambda _, text: public_definitions(text)).where("coalesce(listed, true)")
    found = found.join(inside, [*by, "path"], "left_semi").dropDuplicates([*by, "path", "line", "name"])
    scope = F.when(init, "package").otherwise("module")
    return _points(found, by, "library_python", "library_export", "path", "line", F.col("name"), F.col("said"), {"language": F.lit("python"), "scope": scope, "in_all": F.coalesce("listed", F.lit(False))})


# ---- scripts


def script_names(text: str):
    """(order, line, name, form, how it is declared) of each export."""
    ends = [m.start() for m in re.finditer("\n", text)]
    for k, (form, pattern) in enumerate(NODE_EXPORTS):
        for m in re.finditer(pattern, text):
            held = m.groupdict()
            if "list" in held:
                pairs = re.findall(rf"({NODE_NAME})(?:\s+as\s+({NODE_NAME}))?", held["list"])
                names = [other or name if form == "esm_reexport" else name for name, other in pairs]
            else:
                names = [held["name"]]
            for name in names:
                if name != "default" and not name.startswith("_"):
                    yield k, bisect_left(ends, m.start()) + 1, name, form, held.get("declared")


def script_exports(files: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """Public names that modules in JavaScript and TypeScript export, in either way of modules. Of equal file, line and name the first form counts."""
    parts, suffix = F.split("path", "/"), F.concat(F.lit("."), F.substring_index("path", ".", -1))
    above = F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/")
    mine = files.where(suffix.isin(*NODE_SUFFIXES) & outside(above, NODE_SKIPPED) & F.col("content").rlike(r"export |module\.exports|exports\."))
    fields = (("order", IntegerType()), ("line", IntegerType()), ("name", StringType()), ("form", StringType()), ("declared", StringType()))
    found = _mapped(mine, by, [StructField(*f) for f in fields], lambda _, text: script_names(text))
    rows = found.groupBy(*by, "path", "line", "name").agg(F.min(F.struct("order", "form", "declared")).alias("r")).select(*by, "path", "line", "name", "r.form", "r.declared")
    language = F.when(F.col("path").rlike(r"\.tsx?$"), "typescript").otherwise("javascript")
    return _points(rows, by, "library_node", "library_export", "path", "line", F.col("name"), F.lit(""), {"language": language, "form": F.col("form"), "declared_as": F.col("declared")})


# ---- training and queues


def _called(node: ast.AST) -> ast.Attribute | None:
    """What is called, if that is an attribute of something."""
    return node.func if isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute) else None


def training_functions(text: str):
    """(line, name, first line of the docstring, training calls, whether a configuration framework starts it) of a module's public functions with either."""
    try:
        module = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return
    for at in module.body:
        if isinstance(at, (ast.FunctionDef, ast.AsyncFunctionDef)) and not at.name.startswith("_"):
            calls = sorted({c.attr for n in ast.walk(at) if (c := _called(n)) and c.attr in TRAINING})
            marks = [d.func if isinstance(d, ast.Call) else d for d in at.decorator_list]
            started = any(isinstance(m, ast.Attribute) and m.attr == "main" and isinstance(m.value, ast.Name) and m.value.id == "hydra" for m in marks)
            if calls or started:
                yield at.lineno, at.name, next((x.strip() for x in (ast.get_docstring(at) or "").splitlines() if x.strip()), ""), calls, started


def training_entries(files: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """Functions that train: those that call a step of training on something, or that a configuration framework starts."""
    parts = F.split("path", "/")
    mine = files.where(F.col("path").endswith(".py") & outside(F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/"), COMPOSE_SKIPPED) & F.lower("content").rlike(TRAINING_TEXT))
    fields = (("line", IntegerType()), ("name", StringType()), ("said", StringType()), ("calls", ArrayType(StringType())), ("started", BooleanType()))
    found = _mapped(mine, by, [StructField(*f) for f in fields], lambda _, text: training_functions(text)).dropDuplicates([*by, "path", "line", "name"])
    signals = F.when(F.size("calls") > 0, F.array_join("calls", ","))
    return _points(found, by, "ml_training", "main_function", "path", "line", F.col("name"), F.col("said"), {"framework": F.lit("ml"), "signals": signals, "entrypoint": F.when(F.col("started"), "hydra.main")})


def _texts(node: ast.AST | None) -> list[str]:
    some = node.elts if isinstance(node, (ast.List, ast.Tuple)) else [node]
    return [x.value for x in some if isinstance(x, ast.Constant) and isinstance(x.value, str)]


def python_consumers(text: str):
    """(order, line, symbol, language, library, api, binding, kind of name, name, callback) of each subscription."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return
    for k, node in enumerate(ast.walk(tree)):
        call = _called(node)
        given = {w.arg: w.value for w in node.keywords} if call else {}
        owner = call.value.id if call and isinstance(call.value, ast.Name) else None
        if call and call.attr == "subscribe":
            for topic in _texts(node.args[0] if node.args else None) or [t for t in _texts(given.get("topic")) if t][:1]:
                yield k, node.lineno, f"{owner or 'consumer'}.subscribe:{topic}", "python", "kafka-python", "subscribe", owner or "consumer", "topic", topic, None
        elif call and call.attr == "basic_consume":
            queue, back = (_texts(given.get("queue")) or [""])[0], getattr(given.get("on_message_callback"), "id", "")
            if queue or back:
                yield k, node.lineno, back or f"{owner or 'channel'}.basic_consume:{queue}", "python", "pika", "basic_consume", owner or "channel", "queue" if queue else None, queue or None, back or None


def script_consumers(text: str):
    """The same of scripts; what is in comments isn't there."""
    text = re.sub(r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)", lambda m: re.sub(r"[^\n]", " ", m[0]), text)
    ends = [m.start() for m in re.finditer("\n", text)]
    for k, (library, api, kind, pattern) in enumerate(QUEUE_CALLS):
        for m in re.finditer(pattern, text):
            line, named = bisect_left(ends, m.start()) + 1, m.groupdict()
            for name in re.findall(r"['\"]([^'\"]+)['\"]", named["list"]) if "list" in named else [named.get("named")]:
                symbol = f"{m['binding']}.{api}:{name}" if kind else f"{m['binding']}.run:eachMessage"
                yield k, line, symbol, "javascript", library, api, m["binding"], kind, name, None


def queue_consumers(files: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """Subscriptions to topics, queues and subjects in Python and scripts. Of equal file, line and symbol the first found counts."""
    mine = files.where(outside(F.col("path"), QUEUE_SKIPPED))
    suffix = F.concat(F.lit("."), F.substring_index("path", ".", -1))
    fields = [("order", IntegerType()), ("line", IntegerType()), *((c, StringType()) for c in ("symbol", "language", "library", "api", "binding", "kind", "named", "callback"))]
    fields = [StructField(*f) for f in fields]
    python = _mapped(mine.where(suffix == ".py"), by, fields, lambda _, text: python_consumers(text))
    script = _mapped(mine.where(suffix.isin(*QUEUE_SUFFIXES) & F.col("content").rlike(QUEUE_TEXT)), by, fields, lambda _, text: script_consumers(text))
    rest = ["language", "library", "api", "binding", "kind", "named", "callback"]
    rows = python.unionByName(script).groupBy(*by, "path", "line", "symbol").agg(F.min(F.struct("order", *rest)).alias("r")).select(*by, "path", "line", "symbol", *[f"r.{c}" for c in rest])
    named = {k: F.when(F.col("kind") == k, F.col("named")) for k in ("topic", "queue", "subject")}
    return _points(rows, by, "message_queue_consumer", "mq_consumer", "path", "line", F.col("symbol"), F.lit(""), {**{c: F.col(c) for c in ("language", "library", "binding", "api", "callback")}, **named})


# ---- YAML

_ENTRY = re.compile(r"^(?P<pad>[ \t]*)(?P<dash>-[ \t]+)?(?P<key>[^\s#:'\"\-][^:#]*?)[ \t]*:(?:[ \t]+(?P<value>.*?))?\s*$")


def yaml_entries(text: str):
    """(document, its first line, line, indent, in a list, keys from the top, value) of each line of a key: a reader of events that holds the keys above a line only.

    Values are as written. Lines in blocks of text look like entries if they have that form.
    """
    document, first, open_ = 0, 1, []
    for number, line in enumerate(text.splitlines(), 1):
        if line.strip() == "---":
            document, first, open_ = document + 1, number + 1, []
            continue
        m = _ENTRY.match(line)
        if m is None:
            continue
        indent = len(m["pad"]) + len(m["dash"] or "")
        while open_ and open_[-1][0] >= indent:
            open_.pop()
        open_.append((indent, m["key"]))
        yield document, first, number, indent, m["dash"] is not None, [k for _, k in open_], m["value"] or ""


def yaml_events(files: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """by, path, doc, doc_line, line, indent, item, keys, value and plain: the value without a comment and quotes."""
    names = (("doc", IntegerType()), ("doc_line", IntegerType()), ("line", IntegerType()), ("indent", IntegerType()), ("item", BooleanType()), ("keys", ArrayType(StringType())), ("value", StringType()))
    out = _mapped(files, by, [StructField(*n) for n in names], lambda _, text: yaml_entries(text))
    bare = F.regexp_replace(F.regexp_replace("value", r"\s*#.*$", ""), r"\s+$", "")
    return out.withColumn("plain", F.regexp_replace(bare, r"^[\"']+|[\"']+$", ""))


def compose_services(files: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """The services of compose files, with what their simple keys say."""
    name = F.substring_index("path", "/", -1)
    entries = yaml_events(files.where(name.isin(*COMPOSE_NAMES) & outside(F.col("path"), COMPOSE_SKIPPED)), by=by).where("NOT item AND keys[0] = 'services'")
    key = [*by, "path", F.get("keys", F.lit(1)).alias("service")]
    heads = entries.where((F.size("keys") == 2) & (F.col("indent") == 2) & (F.regexp_replace("value", "^#.*", "") == "")).select(*key, "line").where(F.col("service").rlike(SERVICE_NAME))
    said = entries.where((F.size("keys") == 3) & (F.col("indent") == 4) & (F.col("value") != "")).select(*key, F.get("keys", F.lit(2)).alias("key"), "plain", "line")
    said = said.groupBy(*by, "path", "service").agg(*[F.max_by(F.when(F.col("key") == k, F.col("plain")), F.when(F.col("key") == k, F.col("line"))).alias(k) for k in SERVICE_KEYS])
    rows = heads.join(said, [*by, "path", "service"], "left")
    return _points(rows, by, "iac_docker_compose", "terraform_resource", "path", "line", F.concat(F.lit("services."), "service"), F.lit(""), {"service": F.col("service"), **{k: F.col(k) for k in SERVICE_KEYS}})


def chart_templates(files: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """The documents of a chart's templates that have a kind."""
    path = F.col("path")
    mine = files.where(F.array_contains(F.split(path, "/"), "templates") & F.lower(path).rlike(r"[^/]\.ya?ml$") & outside(path, CHART_SKIPPED))
    entries = yaml_events(mine, by=by).where("NOT item AND value != ''")
    last = F.element_at("keys", -1)
    first = lambda holds: F.min_by(F.when(holds, F.col("value")), F.when(holds, F.col("line")))
    named = (F.get("keys", F.lit(0)) == "metadata") & (F.size("keys") > 1) & (last == "name")
    docs = entries.groupBy(*by, "path", "doc", "doc_line").agg(first(last == "kind").alias("k"), first(last == "apiVersion").alias("v"), first(named).alias("n")).where("k IS NOT NULL")
    symbol = F.concat_ws("/", "k", "n")
    below = F.array_join(F.slice(F.split(path, "/"), F.array_position(F.split(path, "/"), "templates").cast("int"), F.size(F.split(path, "/"))), "/")
    empty = lambda c: F.coalesce(c, F.lit(""))
    out = _points(docs, by, "iac_helm", "helm_template", "path", "doc_line", symbol, F.lit(""), {"kind": F.col("k"), "apiVersion": empty("v"), "name": empty("n"), "template_path": below})
    return out.dropDuplicates([*by, "file", "line", "symbol"])


# ---- models of dbt


def dbt_models(files: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """The models of a project: their documentation is that of ``schema.yml`` in their folder, found by a join on folder and name, or else their first comment."""
    path, parts = F.col("path"), F.split("path", "/")
    above = F.slice(parts, 1, F.size(parts) - 1)
    sql = files.where(path.rlike(r"[^/]\.sql$") & F.array_contains(above, "models") & ~F.arrays_overlap(above, F.array(*map(F.lit, MODEL_SKIPPED))))
    said = F.filter(F.transform(line_array(F.coalesce("content", F.lit(""))), lambda x, i: F.struct((i + 1).alias("n"), F.trim(F.regexp_replace(x, r"^\s+|\s+$", "")).alias("x"))), lambda r: r["x"] != "")
    code = F.get(F.filter(said, lambda r: ~r["x"].startswith("--")), F.lit(0))["n"]
    comment = F.regexp_extract(F.get(said, F.lit(0))["x"], r"^--\s*(.+)$", 1)
    name = F.regexp_replace(F.substring_index("path", "/", -1), r"\.sql$", "")
    models = sql.select(*by, "path", folder(path).alias("folder"), name.alias("model"), F.coalesce(code, F.lit(1)).alias("line"), comment.alias("comment"))
    entries = yaml_events(files.where(F.substring_index("path", "/", -1) == "schema.yml"), by=by)
    last = F.element_at("keys", -1)
    ahead = Window.partitionBy(*by, "path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)  # of one documentation file
    is_name = F.col("item") & (last == "name") & F.col("value").rlike("^[A-Za-z0-9_]+$")
    spoken = entries.withColumn("of", F.last(F.when(is_name, F.struct(F.col("line").alias("at"), F.col("value").alias("model"))), ignorenulls=True).over(ahead))
    spoken = spoken.where((last == "description") & ~F.col("item") & (F.col("indent") > 0) & (F.col("value") != "") & F.col("of").isNotNull())
    each = spoken.groupBy(*by, folder(path).alias("folder"), "of").agg(F.min_by("value", "line").alias("text"))
    plain = F.regexp_replace("text", r"^[\"']+|[\"']+$", "")
    described = each.where(plain != "").groupBy(*by, "folder", "of.model").agg(F.max_by(plain, "of.at").alias("description"))
    rows = models.join(described, [*by, "folder", "model"], "left")
    told = F.coalesce("description", "comment")
    at = F.concat(F.when(F.col("folder") == "", "").otherwise(F.concat("folder", F.lit("/"))), F.lit("schema.yml:#models/"), "model")
    source = F.when(F.col("description").isNotNull(), at)
    return _points(rows, by, "data_pipeline_dbt", "dag_task", "path", "line", F.concat(F.lit("model:"), "model"), told, {"kind": F.lit("model"), "model": F.col("model"), "framework": F.lit("dbt"), "source": source})


# ---- pins of boards


def _closing(text: str, at: int) -> int:
    """Where the bracket at ``at`` is closed, or -1."""
    depth = 0
    for m in re.compile(r"[()]").finditer(text, at):
        depth += 1 if m[0] == "(" else -1
        if not depth:
            return m.start()
    return -1


def module_ports(text: str):
    """(place of the module in the file, module, place of the port, port, direction, width, line) of every port; width: -1 if it depends on parameters. A module without ports is a row without a port."""
    text = re.sub(r"//[^\n]*", "", re.sub(r"/\*[\s\S]*?\*/", "", text))
    ends = [m.start() for m in re.finditer("\n", text)]
    for place, m in enumerate(re.finditer(r"\bmodule\s+(\w+)\b", text)):
        opened = text.find("(", m.end())
        closed = _closing(text, opened) if opened >= 0 else -1
        if closed < 0:
            continue
        second = re.compile(r"\s*\(").match(text, closed + 1)
        if second:  # the first bracket held parameters
            opened, closed = second.end() - 1, _closing(text, second.end() - 1)
            if closed < 0:
                continue
        stop = re.compile(r"\bendmodule\b").search(text, closed + 1)
        if stop is None:
            continue
        head = text[opened + 1 : closed]
        new = any(d in head for d in ("input", "output", "inout"))
        # lines are counted from where the header's text is met first, and in the older style from one character further on: part of the results
        start, part = (text.find(head), head) if new else (text.find(head) + len(head) + 2, text[closed + 1 : stop.start()])
        seen = {}
        for p in re.finditer(PORT if new else OLD_PORT, part):
            for raw in p["names"].split(","):
                name = re.sub(r"\s*\[.*", "", raw.split("=")[0].strip(), flags=re.DOTALL).strip()
                if re.fullmatch(r"[A-Za-z_]\w*", name) and name not in seen:
                    wide = re.fullmatch(r"\s*-?\d+\s*", p["hi"] or "") and re.fullmatch(r"\s*-?\d+\s*", p["lo"] or "")
                    seen[name] = (p["dir"], 1 if p["hi"] is None else abs(int(p["hi"]) - int(p["lo"])) + 1 if wide else -1, sum(e < start + p.start() for e in ends) + 1)
        for k, (name, (direction, width, line)) in enumerate(seen.items()):
            yield place, m[1], k, name, direction, width, line
        if not seen:
            yield place, m[1], 0, None, None, None, None


def board_ports(files: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """The ports of the top module: the one most of whose ports are pinned, or that has most of them if no pin is met; ties go to the first file and name.

    Every pin votes for the modules that have a port of its name; votes are counted by aggregates and the best is a minimum of structs, so no design is gathered.
    """
    path = F.col("path")
    fields = (("place", IntegerType()), ("module", StringType()), ("k", IntegerType()), ("port", StringType()), ("direction", StringType()), ("width", IntegerType()), ("line", IntegerType()))
    ports = _mapped(files.where(path.rlike(r"[^/]\.s?v$") & outside(path, BOARD_SKIPPED)), by, [StructField(*f) for f in fields], lambda _, text: module_ports(text))
    order = F.struct(F.split("path", "/").alias("p"), "place")
    first = ports.groupBy(*by, "module").agg(F.min(order).alias("o")).select(*by, "module", F.array_join("o.p", "/").alias("path"), "o.place")  # of modules of one name
    ports = ports.join(first, [*by, "module", "path", "place"], "left_semi")
    pins = F.concat(F.regexp_extract_all("content", F.lit(PIN_PORT), 1), F.regexp_extract_all("content", F.lit(PIN_PLACE), 1))
    held = files.where(path.rlike(r"^(?:constraints/)?[^/]+\.(?:xdc|lpf|sdc)$")).select(*by, F.col("path").alias("constraint"), F.array_distinct(pins).alias("pins")).where(F.size("pins") > 0)
    held = held.groupBy(*by).agg(F.min(F.struct(F.split("constraint", "/").alias("p"), "constraint", "pins")).alias("h")).select(*by, "h.constraint", F.explode("h.pins").alias("port"))
    pinned = ports.join(held.select(*by, "port"), [*by, "port"]).groupBy(*by, "module").agg(F.countDistinct("port").alias("votes"))
    scored = ports.groupBy(*by, "module").agg(F.count("port").alias("n"), F.min("path").alias("path")).join(pinned, [*by, "module"], "left")
    top = scored.groupBy(*by).agg(F.min(F.struct((-F.coalesce("votes", F.lit(0))).alias("v"), (-F.when(F.coalesce("votes", F.lit(0)) > 0, 0).otherwise(F.col("n"))).alias("n"), "path", "module")).alias("t"))
    rows = ports.join(top.select(*by, "t.module"), [*by, "module"], "left_semi").where("port IS NOT NULL")
    named = held.select(*by, "constraint").distinct()
    rows = rows.join(named, list(by), "left") if by else rows.join(F.broadcast(named.groupBy().agg(F.max("constraint").alias("constraint"))))
    return _points(rows, by, "fpga_verilog", "fpga_toplevel_port", "path", "line", F.col("port"), F.lit(""), {"port_direction": F.col("direction"), "port_width_bits": F.col("width"), "module": F.col("module"), "constraint_file": F.col("constraint")})
