"""Personal data: high-recall span generators, boosted trees over format and context, calibrated thresholds.

Everything that touches rows is a DataFrame expression. One scan of the texts runs the generators and
writes, per document, the matches with the lengths of the gaps between them (``split`` gives the gaps,
``regexp_extract_all`` the matches: offsets are running sums of both). All later steps read that small table.

The strict (base) forms of email, ip, card and phone always count. The other candidates are strict matches that failed validation,
looser forms, and long keys (``secret``, a kind without a base form); they may overlap each other, but no base span.
Whether a candidate is personal data is learned from evidence that isn't in it: documents agree. A document with one kind of
personal data tends to hold others, so boosted depth-two trees predict, from a candidate's format and its neighbourhood, whether its
document holds a base span of another kind. Numbers, versions and the like do so as seldom as any document; unlisted forms of
personal data as often as base spans do. With B the rate of all documents, V that of base spans and A that of the
candidates at a score or above (its lower confidence bound), their precision is about (A - B) / (V - B). A kind's threshold is the
lowest that keeps ``precision``, by scores of trees fitted on the other half of the candidates; a kind for
which none does adds nothing. Trees, rates and thresholds come from every candidate of every text. The fitted trees are one SQL expression.

Defined results: null and empty texts have no spans. Rows are handled one by one, so repeated rows
and null or repeated ids do no harm. Offsets are code points. Columns of any name stay; ``detect`` replaces ``base`` and ``spans``. Patterns
use possessive repeats and start only where a match could start, so that long runs cost time in proportion to their length.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import free_name, written

KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")

# The strict forms. \G is the end of the match before, from where the search goes on.
STRICT = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

#: Looser generators: high recall, many false candidates.
LOOSE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++\s{0,2}(?:\[at\]|\(at\)|\{at\})\s{0,2}[A-Za-z0-9-]++(?:\s{0,2}(?:\.|\[dot\]|\(dot\))\s{0,2}[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9.,])[0-9]{1,3}+(?:\s?[.,:]\s?[0-9]{1,3}+){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9]{4}(?:[./_\x20-]{1,2}[0-9]{4}){3}(?![0-9])",
    "secret": r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{20,}+={0,2}",
    "phone": r"(?<![0-9A-Za-z])(?:00[0-9]{1,3}[\x20.-])?\(?[0-9]{2,4}\)?[\x20./-]{1,2}[0-9]{3,4}[\x20.-][0-9]{3,5}(?![0-9])",
}

_QUICK = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9][ -]?[0-9]", "phone": r"\+[0-9]"}
_QUICK_LOOSE = {"email": r"[\[({]at[\])}]", "ip": r"[0-9]\s?[.,:]\s?[0-9]", "card": r"[0-9]{4}[./_ -]", "phone": r"[0-9]{2}\)?[ ./-]", "secret": "[A-Za-z0-9+/_-]{20}"}
_CONTEXT = 24


def _matches(pattern: str, quick: str, text: str) -> str:
    p, q = pattern.replace("\\", "\\\\").replace("'", "\\'"), quick.replace("\\", "\\\\")
    return (
        f"CASE WHEN {text} RLIKE '{q}' THEN zip_with(split({text}, '{p}', -1), regexp_extract_all({text}, '{p}', 0), "
        f"(g, v) -> named_struct('g', length(g), 'v', v, 'l', right(g, {_CONTEXT}), 'h', left(g, 8))) END"
    )


def generate(docs: DataFrame, out: str, text: str = "text") -> DataFrame:
    """``docs`` with a struct ``out`` of one array per generator: gap length, match, left context and head of the gap."""
    arrays = [f"{_matches(STRICT[k], _QUICK[k], f'`{text}`')} AS s_{k}" for k in KINDS]
    arrays += [f"{_matches(LOOSE[k], _QUICK_LOOSE[k], f'`{text}`')} AS w_{k}" for k in ALL_KINDS]
    return docs.withColumn(out, F.struct(*map(F.expr, arrays)))


_SPAN = "array<struct<kind:string,s:int,e:int,v:string,l:string,r:string>>"


def _placed(col: str, kind: str) -> str:
    """Spans with offsets. Running sums go in blocks of 128, so that long arrays cost no square."""
    pairs = f"zip_with({col}, slice({col}, 2, greatest(size({col}), 1)), (a, b) -> named_struct('g', a.g, 'v', a.v, 'l', a.l, 'r', b.h))"
    blocks = f"transform(sequence(0, (size({col}) - 1) div 128), b -> slice({pairs}, b * 128 + 1, 128))"
    based = (
        f"aggregate({blocks}, named_struct('pos', 0, 'out', cast(array() as array<struct<base:int,blk:array<struct<g:int,v:string,l:string,r:string>>>>)), "
        "(a, blk) -> named_struct('pos', a.pos + aggregate(blk, 0, (t, x) -> t + x.g + coalesce(length(x.v), 0)), "
        "'out', concat(a.out, array(named_struct('base', a.pos, 'blk', blk)))), a -> a.out)"
    )
    placed = (
        f"flatten(transform({based}, p -> aggregate(p.blk, named_struct('pos', p.base, 'out', cast(array() as {_SPAN})), "
        "(a, x) -> named_struct('pos', a.pos + x.g + coalesce(length(x.v), 0), 'out', "
        f"CASE WHEN x.v IS NULL THEN a.out ELSE concat(a.out, array(named_struct('kind', '{kind}', 's', a.pos + x.g, "
        "'e', a.pos + x.g + length(x.v), 'v', x.v, 'l', x.l, 'r', x.r))) END), a -> a.out)))"
    )
    return f"CASE WHEN size({col}) > 1 THEN {placed} ELSE cast(array() as {_SPAN}) END"


_DIGITS = "regexp_replace(x.v, '[^0-9]', '')"
_LUHN = (
    f"aggregate(filter(split(reverse({_DIGITS}), ''), c -> c != ''), named_struct('t', 0, 'i', 0), (a, c) -> named_struct("
    "'t', a.t + CASE WHEN a.i % 2 = 0 THEN int(c) WHEN int(c) > 4 THEN 2 * int(c) - 9 ELSE 2 * int(c) END, 'i', a.i + 1), a -> a.t % 10 = 0)"
)
_VALID = {
    "email": "true",
    "ip": r"x.v RLIKE '^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\\.|$)){4}$'",
    "card": f"CASE WHEN length({_DIGITS}) BETWEEN 13 AND 19 THEN {_LUHN} ELSE false END",
    "phone": f"length({_DIGITS}) BETWEEN 9 AND 15",
}

FEATURES = {
    "digits": "length(regexp_replace(x.v, '[^0-9]', ''))",
    "length": "length(x.v)",
    "separators": "length(regexp_replace(x.v, '[0-9A-Za-z]', ''))",
    "groups": "size(filter(split(x.v, '[^0-9]+'), c -> c != ''))",
    "longest": "array_max(transform(split(x.v, '[^0-9]+'), c -> length(c)))",
    "letters": "length(regexp_replace(x.v, '[^A-Za-z]', ''))",
    "dots": "length(x.v) - length(replace(x.v, '.', ''))",
    "spaces": "length(x.v) - length(replace(x.v, ' ', ''))",
    "hyphens": "length(x.v) - length(replace(x.v, '-', ''))",
    "plus": "int(x.v LIKE '%+%')",
    "paren": "int(x.v LIKE '%(%')",
    "at": "int(x.v RLIKE '@|[\\\\[({]at')",
    "zero_first": "int(x.v LIKE '0%')",
    "left_glued": "int(x.l RLIKE '[0-9A-Za-z_./-]$')",
    "right_glued": "int(x.r RLIKE '^[0-9A-Za-z_/-]')",
    "left_quoted": "int(x.l RLIKE '[=\"\\'#:]\\\\s*$')",
    "right_dot_digit": "int(x.r RLIKE '^[.,][0-9]')",
    "said": "int(lower(x.l) RLIKE '(mail|contact|tel|phone|call|fax|mobile|card|visa|pay|host|addr|write)[^a-z]*$')",
    "technical": "int(lower(x.l) RLIKE '(token|key|id|version|hash|commit|isbn|doi|port|page|line|no)[^a-z]*$')",
    "kind": "array_position(array('email', 'ip', 'card', 'phone', 'secret'), x.kind)",
}
#: Cells of a feature (whole numbers up to 31, from there on 16 to an octave), parts of one in sums, steps of a margin of one and the widest margin told apart.
CELLS, ONE, STEPS, WIDEST = 512, 1 << 24, 1 << 10, 32
_OCTAVE = "(length(bin(v)) - 5)"
_VECTOR = f"transform(array({', '.join(FEATURES.values())}), v -> CASE WHEN v < 32 THEN v ELSE 16 * {_OCTAVE} + shiftright(v, {_OCTAVE}) END)"


def candidates(generated: DataFrame, out: str) -> DataFrame:
    """The generators' arrays as ``out.base`` (strict and valid, by kind, then start) and ``out.open``: every candidate that overlaps none of these."""
    strict, failed, loose = [], [], []
    for k in KINDS:
        placed = _placed(f"`{out}`.s_{k}", k)
        strict.append(f"filter({placed}, x -> {_VALID[k]})")
        failed.append(f"filter({placed}, x -> NOT ({_VALID[k]}) AND length({_DIGITS}) >= 4)")
    loose = [_placed(f"`{out}`.w_{k}", k) for k in ALL_KINDS]
    empty = f"cast(array() as {_SPAN})"
    some = " OR ".join([f"size(`{out}`.s_{k}) > 1" for k in KINDS] + [f"size(`{out}`.w_{k}) > 1" for k in ALL_KINDS])
    found = generated.withColumn(out, F.expr(
        f"CASE WHEN {some} THEN named_struct('base', concat({', '.join(strict)}), 'open', concat({', '.join(failed + loose)})) "
        f"ELSE named_struct('base', {empty}, 'open', {empty}) END"
    ))
    # base spans in blocks by start: a candidate is held against the blocks that it may touch, not against all spans
    ordered = f"array_sort(transform(`{out}`.base, b -> named_struct('s', b.s, 'e', b.e)))"
    blocks = (
        f"transform(array({ordered}), o -> transform(sequence(0, (size(o) - 1) div 128), i -> slice(o, i * 128 + 1, 128)))[0]"
    )
    spread = f"transform({blocks}, b -> named_struct('lo', b[0].s, 'hi', array_max(transform(b, y -> y.e)), 'of', b))"
    apart = f"transform(array({spread}), k -> filter(`{out}`.open, x -> NOT exists(filter(k, b -> b.lo < x.e AND b.hi > x.s), b -> exists(b.of, y -> y.s < x.e AND y.e > x.s))))[0]"
    return found.withColumn(out, F.expr(f"named_struct('base', `{out}`.base, 'open', CASE WHEN size(`{out}`.base) > 0 AND size(`{out}`.open) > 0 THEN {apart} ELSE `{out}`.open END)"))


class Boosted:
    """Depth-two regression trees on the logistic loss, grown from sums by feature and cell and written out as SQL."""

    def __init__(self, rounds: int = 30, rate: float = 0.25, l2: float = 2.0):
        self.rounds, self.rate, self.l2, self.bias, self.trees = rounds, rate, l2, 0.0, []

    def start(self, mean: float) -> Boosted:
        rate = min(max(mean, 1e-3), 1 - 1e-3)
        self.bias = float(np.log(rate / (1 - rate)))
        return self

    def leaf(self, g: float, h: float) -> float:
        return float(-self.rate * g / (h + self.l2))

    def best(self, some: np.ndarray):
        """(feature, cut, sums to its left, sums to its right) of the best cut of a node, or None; ``some``: rows, gradients and curvatures by feature and cell."""
        left = some.cumsum(axis=2)
        whole = left[:, :1, -1:]
        (g, h), (gt, ht) = left[1:] / ONE, whole[1:] / ONE
        gain = g**2 / (h + self.l2) + (gt - g) ** 2 / (ht - h + self.l2) - gt * gt / (ht + self.l2)
        gain[(some[0] == 0) | (left[0] == whole[0])] = -1  # cuts lie behind cells that hold rows, but for a feature's last
        j, v = np.unravel_index(int(np.argmax(gain)), gain.shape)
        if gain[j, v] <= 1e-9:
            return None
        after = v + 1 + int(np.flatnonzero(some[0, j, v + 1 :])[0])
        return int(j), float(v + after) / 2, left[1:, j, v] / ONE, (left[1:, j, -1] - left[1:, j, v]) / ONE

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        """Of rows in memory, by the same sums."""
        x, n, fixed = x.astype(int), np.ones(len(y), int), np.rint(y * ONE).astype(int)
        grow([self.start(y.mean())], lambda models, nodes: sums(x, n, fixed, np.zeros(len(y), int), models, nodes))
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.bias)
        for tree in self.trees:
            for path, w in tree:
                f[_reached(x, path)] += w
        return f

    def sql(self, vector: str) -> str:
        def case(tree):
            arms = " ".join(
                "WHEN " + (" AND ".join(f"{vector}[{j}] {'<=' if left else '>'} {t!r}D" for j, t, left in path) or "true") + f" THEN {w!r}D"
                for path, w in tree
            )
            return f"CASE {arms} ELSE 0D END"

        return f"({self.bias!r}D" + "".join(f" + {case(t)}" for t in self.trees) + ")"


def _reached(x: np.ndarray, path) -> np.ndarray:
    hit = np.ones(len(x), bool)
    for j, t, left in path:
        hit &= (x[:, j] <= t) == left
    return hit


def sums(x: np.ndarray, n: np.ndarray, y: np.ndarray, half: np.ndarray, models: list[Boosted], nodes) -> np.ndarray:
    """Rows, gradients and curvatures of each node (a model's place, a path) by feature and cell. Models 0 and 1 learn from that half, any other from all rows
    (a single one, too). ``n`` rows share a vector, ``y`` is the sum of theirs in parts of ``ONE``. All are whole numbers, so the order of rows doesn't matter."""
    width = x.shape[1]
    cells = x + np.arange(width) * CELLS
    out = np.zeros((len(nodes), 3, width, CELLS), np.int64)
    for k, model in enumerate(models):
        mine = [i for i, node in enumerate(nodes) if node[0] == k]
        if not mine:
            continue
        p = 1 / (1 + np.exp(-model.margin(x)))
        parts = (n, np.rint(n * p * ONE).astype(np.int64) - y, np.rint(n * p * (1 - p) * ONE).astype(np.int64))
        of = np.ones(len(n), bool) if k > 1 or len(models) == 1 else half == k
        for i in mine:
            rows = of & _reached(x, nodes[i][1])
            for c, part in enumerate(parts):
                np.add.at(out[i, c].reshape(-1), cells[rows], part[rows, None])
    return out


def grow(models: list[Boosted], summed) -> None:
    """A tree a round for every model. ``summed(models, nodes)`` gives what ``sums`` gives, of all rows there are."""
    for _ in range(models[0].rounds):
        trees, nodes = [[] for _ in models], [(k, ()) for k in range(len(models))]
        for depth in range(2):
            deeper = []
            for (k, path), some in zip(nodes, summed(models, nodes) if nodes else (), strict=True):
                cut = models[k].best(some)
                if cut is None:
                    trees[k].append((path, models[k].leaf(*(some[1:, 0].sum(axis=1) / ONE))))
                    continue
                j, t, *sides = cut
                for left, (g, h) in zip((True, False), sides, strict=True):
                    if depth == 0:
                        deeper.append((k, ((j, t, left),)))
                    else:
                        trees[k].append(((*path, (j, t, left)), models[k].leaf(g, h)))
            nodes = deeper
        for model, tree in zip(models, trees, strict=True):
            model.trees.append(tree)


def _array(values) -> str:
    return "array(" + ", ".join(v if isinstance(v, str) else f"{v!r}D" for v in values) + ")"


def _flat(tree) -> list[float]:
    """A tree as feature and cut of its root, then of either side feature, cut and two weights; a cut that isn't there lies above all cells."""
    paths = dict(tree)
    root = next((path[0][:2] for path in paths if path), (0, float(CELLS)))
    out = [float(root[0]), root[1]]
    for left in (True, False):
        way = ((*root, left),)
        below = next((path[1][:2] for path in paths if path[:1] == way and len(path) == 2), None)
        if below is None:
            w = paths.get(way, paths.get((), 0.0))
            out += [0.0, float(CELLS), w, w]
        else:
            out += [float(below[0]), below[1], paths[(*way, (*below, True))], paths[(*way, (*below, False))]]
    return out


def _margin(models: list[Boosted], k: str) -> str:
    """The margin of ``f`` by the model whose place is ``k``. The trees are constants of the plan, so that one compiled plan does for all rounds."""
    trees = _array([_array([_array(_flat(t)) for t in m.trees]) if m.trees else "cast(array() as array<array<double>>)" for m in models])
    weight = "IF(f[int(t[0])] <= t[1], IF(f[int(t[2])] <= t[3], t[4], t[5]), IF(f[int(t[6])] <= t[7], t[8], t[9]))"
    return f"aggregate({trees}[{k}], {_array([m.bias for m in models])}[{k}], (a, t) -> a + {weight})"


def _summed(vectors: DataFrame):
    """``sums`` over a table of vectors, as an aggregate by node, feature and cell."""
    each = vectors.selectExpr("explode(array(half, 2)) AS k", "f", "n", "y")  # a row teaches the model of its half and that of all

    def job(models, nodes):
        at = {}  # of each model: feature and cut of the path, nodes to the left and right of it
        for i, (k, path) in enumerate(nodes):
            j, t, left = path[0] if path else (0, float(CELLS), True)
            at.setdefault(k, [float(j), t, -1.0, -1.0])[2 if left else 3] = float(i)
        cuts = f"{_array([_array(at.get(k, [0.0, float(CELLS), -1.0, -1.0])) for k in range(len(models))])}[k]"
        some = each.selectExpr("f", "n", "y", f"int(IF(f[int({cuts}[0])] <= {cuts}[1], {cuts}[2], {cuts}[3])) AS node", f"1 / (1 + exp(-{_margin(models, 'k')})) AS p").where("node >= 0")
        parts = some.selectExpr("node", "posexplode(f) AS (feature, cell)", "n", f"bigint(round(n * p * {ONE})) - y AS g", f"bigint(round(n * p * (1 - p) * {ONE})) AS h")
        got = parts.groupBy("node", "feature", "cell").agg(*[F.sum(c).alias(c) for c in ("n", "g", "h")]).toArrow()
        node, feature, cell, *totals = (got.column(c).to_numpy() for c in ("node", "feature", "cell", "n", "g", "h"))
        out = np.zeros((len(nodes), 3, len(FEATURES), CELLS), np.int64)
        for c, total in enumerate(totals):
            out[node, c, feature, cell] = total
        return out

    return job


def _scored(vectors: DataFrame, models: list[Boosted]) -> DataFrame:
    """kind, step, n, y: the open candidates by score, in steps of margin, from the trees that didn't learn from their half."""
    step = f"bigint(greatest(least(floor({_margin(models, '(1 - half)')} * {STEPS}), {WIDEST * STEPS}), {-WIDEST * STEPS})) AS step"
    some = vectors.where("base = 0").selectExpr(f"f[{len(FEATURES) - 1}] AS kind", step, "n", "y")
    return some.groupBy("kind", "step").agg(F.sum("n").alias("n"), F.sum("y").alias("y"))


def fit(found: DataFrame, out: str, *, precision: float = 0.8, z: float = 1.0):
    """(model, {kind: threshold margin}) from every candidate, base spans among them.

    Equal matches after equal contexts count once, with the mean of what their documents say: they are merged within each task before
    any shuffle. They then become counts by vector, in a written table, which each level of a round's trees reads once: gradients are summed by node, feature and cell, and
    only these sums, bounded however long the table, come to the driver. Two of the models learn from a half each, to score the other one's candidates for the thresholds.
    Where base spans agree no more than any documents do, nothing is learned: (None, {}).
    """
    docs = found.select(F.expr(f"`{out}`.base").alias("base"), F.expr(f"`{out}`.open").alias("open"))
    every = docs.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.size("base") > 0, 1)).alias("held")).first()
    kinds = docs.where("size(base) + size(open) > 0").withColumn("kinds", F.expr("array_distinct(transform(base, b -> b.kind))"))
    each = kinds.selectExpr(
        "kinds", "explode(concat(transform(base, x -> named_struct('base', 1, 'x', x)), transform(open, x -> named_struct('base', 0, 'x', x)))) AS c"
    ).selectExpr("kinds", "c.base AS base", "c.x AS x")
    each = each.selectExpr("base", f"named_struct('s', x.s, 'e', x.e, 'r', x.r, 'f', {_VECTOR}) AS x", "double(size(array_remove(kinds, x.kind)) > 0) AS y", "xxhash64(x.kind, x.v, x.l) AS hash")
    once = each.groupBy("hash", "base").agg(F.min("x").alias("x"), F.avg("y").alias("y")).selectExpr("base", "int(hash & 1) AS half", "x.f AS f", f"bigint(round(y * {ONE})) AS y")
    vectors = written(once.groupBy("half", "base", "f").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y")), "pii_vectors")
    counts = {(r.half, r.base): (r.n, r.y / ONE) for r in vectors.groupBy("half", "base").agg(F.sum("n").alias("n"), F.sum("y").alias("y")).collect()}
    if {h for h, _ in counts} != {0, 1} or {b for _, b in counts} != {0, 1}:
        return None, {}

    def mean(some):
        n, y = np.sum([v for k, v in counts.items() if some(*k)], axis=0)
        return float(y / n)

    everywhere, valid = every.held / every.n, mean(lambda half, base: base == 1)
    if valid <= everywhere:
        return None, {}
    models = [Boosted().start(mean(lambda half, base, k=k: half == k)) for k in (0, 1)] + [Boosted().start(mean(lambda half, base: True))]
    grow(models, _summed(vectors))
    scored = np.array(sorted(map(tuple, _scored(vectors, models).collect())), np.int64).reshape(-1, 4)[::-1]
    thresholds = {}
    for i, name in enumerate(ALL_KINDS, 1):
        mine = scored[scored[:, 0] == i]
        if not len(mine):
            continue
        steps, n = mine[:, 1], np.cumsum(mine[:, 2])
        rate = np.cumsum(mine[:, 3]) / ONE / n
        low = (rate + z * z / (2 * n) - z * np.sqrt(np.maximum(rate * (1 - rate), 0) / n + z * z / (4.0 * n * n))) / (1 + z * z / n)  # Wilson's bound
        below = np.append(steps[1:] + 1, steps[-1] - STEPS)
        good = np.flatnonzero((low - everywhere) / (valid - everywhere) >= precision)
        if len(good):  # between that step and the next below it, as the trees of all candidates score a little differently
            thresholds[name] = float(steps[good[-1]] + below[good[-1]]) / 2 / STEPS
    return (models[2], thresholds) if thresholds else (None, {})


def select_spans(found: DataFrame, out: str, model, thresholds: dict[str, float]) -> DataFrame:
    """``found`` with ``out.base`` and ``out.spans``: arrays of (kind, s, e) by kind, then start."""
    plain = "transform({}, x -> named_struct('kind', x.kind, 's', x.s, 'e', x.e))"
    base = plain.format(f"`{out}`.base")
    spans = base
    if thresholds:
        limit = "CASE x.kind " + " ".join(f"WHEN '{k}' THEN {t!r}D" for k, t in thresholds.items()) + " ELSE double('Infinity') END"
        kept = f"filter(`{out}`.open, x -> transform(array({_VECTOR}), f -> {model.sql('f')})[0] >= {limit})"
        order = "array_position(array('email', 'ip', 'card', 'phone', 'secret'), a.kind)"
        ordered = f"array_sort(transform(concat({base}, {plain.format(kept)}), a -> named_struct('k', {order}, 's', a.s, 'e', a.e, 'kind', a.kind)))"
        once = f"transform(array({ordered}), o -> filter(o, (x, i) -> i = 0 OR o[i - 1].k != x.k OR o[i - 1].s != x.s OR o[i - 1].e != x.e))[0]"  # they are sorted
        ranked = f"transform({once}, a -> named_struct('kind', a.kind, 's', a.s, 'e', a.e))"
        spans = f"CASE WHEN size(`{out}`.open) > 0 THEN {ranked} ELSE {base} END"
    return found.withColumn(out, F.expr(f"named_struct('base', {base}, 'spans', {spans})"))


def _found(docs: DataFrame, out: str, text: str, keep_text: bool, training: dict) -> DataFrame:
    made = generate(docs, out, text)
    found = candidates(written(made if keep_text else made.drop(text), "pii"), out)
    return select_spans(found, out, *fit(found, out, **training))


def detect(docs: DataFrame, *, text: str = "text", keep_text: bool = False, **training) -> DataFrame:
    """``docs`` (without its text unless ``keep_text``) with ``base`` and ``spans``."""
    out = free_name(docs, "found")
    found = _found(docs, out, text, keep_text, training)
    return found.select(*[c for c in found.columns if c not in (out, "base", "spans")], f"{out}.base", f"{out}.spans")


CHUNK = 1024


def redact(docs: DataFrame, *, text: str = "text", **training) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; overlapping spans go as one, under the first kind.

    What stays is cut from chunks of the text and joined once, so time is in proportion to the text and its spans.
    """
    out = free_name(docs, "found")
    cut = (
        f"named_struct('c', regexp_extract_all(`{text}`, '(?s).{{1,{CHUNK}}}', 0), "
        f"'sp', array_sort(transform(`{out}`.spans, x -> named_struct('s', x.s, 'e', x.e, 'kind', x.kind))))"
    )
    maxima = "transform(sequence(0, (size(z.sp) - 1) div 256), b -> array_max(transform(slice(z.sp, b * 256 + 1, 256), y -> y.e)))"
    before = "greatest(0, array_max(slice(z.m, 1, i div 256)), array_max(transform(slice(z.sp, (i div 256) * 256 + 1, i % 256), y -> y.e)))"  # the end so far

    def piece(low: str, high: str) -> str:
        return f"substring(array_join(slice(z.c, {low} div {CHUNK} + 1, {high} div {CHUNK} - {low} div {CHUNK} + 1), ''), {low} % {CHUNK} + 1, {high} - {low})"

    parts = (
        f"concat(transform(z.sp, (x, i) -> transform(array({before}), p -> CASE WHEN x.s >= p THEN concat({piece('p', 'x.s')}, '[', upper(x.kind), ']') ELSE '' END)[0]), "
        f"array(transform(array(array_max(z.m)), p -> {piece('p', f'length(`{text}`)')})[0]))"
    )
    with_maxima = f"transform(array({cut}), z -> named_struct('c', z.c, 'sp', z.sp, 'm', {maxima}))"
    clean = f"transform({with_maxima}, z -> array_join({parts}, ''))[0]"
    found = _found(docs, out, text, True, training)
    return found.withColumn(text, F.when(F.expr(f"size(`{out}`.spans) > 0"), F.expr(clean)).otherwise(F.col(f"`{text}`"))).select(*[f"`{c}`" for c in docs.columns])


def _joined(spans: str) -> str:
    return f"array_join(transform({spans}, x -> concat(x.kind, ':', x.s, ':', x.e)), ',')"


def op8(spark, sf_dir: str) -> DataFrame:
    """The contract's kinds in ``spans``; ``n_secret`` and ``n_spans`` count what the operator finds besides."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    counts = [F.expr(f"bigint(size(filter(base, x -> x.kind = '{k}'))) AS n_{k}") for k in KINDS]
    listed = "filter(spans, x -> x.kind != 'secret')"
    more = [F.expr(f"bigint(size(spans) - size({listed})) AS n_secret"), F.expr("bigint(size(spans)) AS n_spans")]
    return detect(docs).select("doc_id", *counts, F.expr(f"sha2({_joined('base')}, 256) AS base_sha256"), F.expr(f"{_joined(listed)} AS spans"), *more)
