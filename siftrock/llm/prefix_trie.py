"""The prefix trie of conversations: how many begin alike, and what a shared prefix saves.

A node is a distinct sequence of first turns. Its key is its depth and the exclusive-or of 128-bit hashes of (place, role, text), so keys
are prefix sums, which need no conversation in one task: turns are numbered by one range-partitioned sort and counts of its
runs, and sums are taken within blocks of ``BLOCK`` turns and carried over the blocks. A node is known by its smallest member and its
depth from then on.

Sums over subtrees follow the heavy-path decomposition: each node's child of most members (of the smallest id, if several) continues its path, all
others begin paths of their own. A path is an array of nodes by depth, and suffix sums along it add up
everything below but for the light paths, which are attached to their parents before. The head of a light path has at most half its parent's members, so paths
whose heads have 2^k to 2^(k+1) - 1 members only wait for those of smaller k: as many rounds as there are values of k, at most
the logarithm of the number of conversations.

Defined results: null roles and texts are empty; turns of equal number, or none (these come first), are ordered by the hash of role and text, and
repeated ones stay. Rows without a conv_id take no part. An empty table has no nodes.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import fresh_path, written

BLOCK = 8  # 2^8 turns
CHUNK = 12  # 2^12 ids
KEY = ["depth", "k1", "k2"]
RESULT = "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
NOTHING = hashlib.sha256(b"").hexdigest()


def narrow(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, said, words) of turns: ``said`` is the hash of role and text. Texts go no further than this."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    said = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    return turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", said.alias("said"), words.cast("long").alias("words"))


def numbered(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows``, sorted and written, with ``at``, and the runs of each conversation in it: (conv_id, part, shift, size).

    A turn's place from 1 is ``at + shift`` of its run, that of the same ``part``; ``size`` counts the conversation's turns. However long a
    conversation is, it is spread over as many parts as its share of the rows.
    """
    order = ["conv_id", "turn", "said"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    rows = written(rows.withColumn("part", F.shiftright("at", 33)), "turns")
    runs = rows.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    ordered, whole = Window.partitionBy("conv_id").orderBy("part"), Window.partitionBy("conv_id")
    before = F.sum("n").over(ordered) - F.col("n")
    return rows, runs.select("conv_id", "part", (before - F.col("first") + 1).alias("shift"), F.sum("n").over(whole).alias("size"))


def plain_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns as (conv_id, depth, said, words, last), members as (conv_id, size)) of conversations as they are."""
    rows, runs = numbered(narrow(turns))
    depth = F.col("at") + F.col("shift")
    rows = rows.join(runs, ["conv_id", "part"]).select("conv_id", depth.alias("depth"), "said", "words", (depth == F.col("size")).alias("last"))
    return rows, runs.groupBy("conv_id").agg(F.max("size").alias("size"))


def shared_beginnings(turns: DataFrame, *, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """The same of conversations that begin with others' turns: of conversation c the first h turns are those of c - c % ``every`` (all, if
    fewer), h = crc32(c) % ``most``, then come its own but the first h. Only ids, hashes and at most ``every * most`` rows of such a beginning are joined.
    """
    rows, runs = numbered(narrow(turns))
    runs = written(runs, "runs")
    c, h = F.col("conv_id"), F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    sizes = runs.groupBy("conv_id").agg(F.max("size").alias("own"))
    convs = sizes.select("conv_id", "own", h.alias("h"), (c - c % every).alias("of"))
    heads = sizes.select(c.alias("of"), F.col("own").alias("there"))
    there = F.least("h", F.coalesce("there", F.lit(0)))
    convs = convs.join(heads, "of", "left").withColumn("head", there).withColumn("size", F.col("head") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
    convs = written(convs.select("conv_id", "of", "h", "head", "size"), "beginnings")
    place = F.col("at") + F.col("shift")
    runs = runs.drop("size").join(convs, "conv_id")
    own = rows.join(runs, ["conv_id", "part"]).where(place > F.col("h")).select("conv_id", (place - F.col("h") + F.col("head")).alias("depth"), "said", "words", "size")
    first = rows.where(c % every == 0).join(runs.select("conv_id", "part", "shift"), ["conv_id", "part"]).where(place < most)
    first = first.select(c.alias("of"), place.alias("depth"), "said", "words").join(convs.where("head > 0"), "of").where("depth <= head")
    names = ["conv_id", "depth", "said", "words", (F.col("depth") == F.col("size")).alias("last")]
    return own.select(*names).unionAll(first.select(*names)), convs.select("conv_id", "size")


def carried(rows: DataFrame, owner: list[str], block: str, values: dict[str, Column], *, backward: bool = False) -> DataFrame:
    """``rows`` with the aggregates ``values`` of all blocks before a row's own (behind it, if ``backward``), null in the first.

    Blocks are few beside rows, so that a path of any length is split; ``values`` are aggregates that can be aggregated again.
    """
    sums = rows.groupBy(*owner, block).agg(*[v.alias(k) for k, v in values.items()])
    order = F.col(block).desc() if backward else F.col(block)
    before = Window.partitionBy(*owner).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    again = {k: getattr(F, "bit_xor" if k.startswith("x") else "max" if k.startswith("top") else "sum") for k in values}
    sums = sums.select(*owner, block, *[again[k](k).over(before).alias(f"{k}_before") for k in values]).where(" OR ".join(f"{k}_before IS NOT NULL" for k in values))
    return rows.join(sums, [*owner, block], "left")


def keyed(rows: DataFrame) -> DataFrame:
    """Turns with the keys of the nodes that they end, and those of the parents (p1, p2)."""
    rows = rows.withColumns({"block": F.shiftright(F.col("depth") - 1, BLOCK), **{f"x{i}": F.xxhash64(F.lit(i), "depth", "said") for i in (1, 2)}})
    rows = carried(rows, ["conv_id"], "block", {f"x{i}": F.bit_xor(f"x{i}") for i in (1, 2)})
    within = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    for i in (1, 2):
        rows = rows.withColumn(f"k{i}", F.bit_xor(f"x{i}").over(within).bitwiseXOR(F.coalesce(f"x{i}_before", F.lit(0))))
    parents = [F.col(f"k{i}").bitwiseXOR(F.col(f"x{i}")).alias(f"p{i}") for i in (1, 2)]
    return rows.select("conv_id", *KEY, *parents, "words", "last")


def with_parents(nodes: DataFrame, root) -> DataFrame:
    """Nodes with parent_conv_id, n_children and heavy: whether they continue their parent's path."""
    below = nodes.where("depth > 0")
    up = [(F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")]
    kids = below.select(*up, "n_convs", "conv_id").groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_children"), F.max(F.struct("n_convs", -F.col("conv_id"))).alias("most"))
    nodes = written(nodes.join(kids, KEY, "left"), "trie-children")
    heavy = nodes.where("most IS NOT NULL").select((-F.col("most.col2")).alias("conv_id"), (F.col("depth") + 1).alias("depth"), F.lit(True).alias("heavy"))
    # all children of a node ask it for its id: ordinary skew of many small rows on one side, the root's children left out
    ids = nodes.where("n_children IS NOT NULL AND depth > 0").select(F.col("conv_id").alias("parent_conv_id"), (F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"))
    deep = written(nodes.where("depth > 1").join(ids, ["depth", "p1", "p2"]), "trie-parents")
    shallow = nodes.where("depth <= 1").withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(root.conv_id)).cast("long"))
    both = deep.select(*shallow.columns).unionAll(shallow)
    kept = ["conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "words", F.coalesce("heavy", F.lit(False)).alias("heavy"), "k1", "k2"]
    return written(both.join(heavy, ["conv_id", "depth"], "left").select(*kept), "trie-heavy")


def with_paths(nodes: DataFrame) -> DataFrame:
    """Nodes with the head of their heavy path (head_conv, top.depth) and its members (top.n_convs).

    The nodes of one smallest member are a run of depths. Within it the head is the last light node so far; where a run begins with a heavy
    node, it is that of the run above, found by doubling pointers from run to run.
    """
    top = F.when(~F.col("heavy"), F.struct("depth", "n_convs"))
    nodes = carried(nodes.withColumn("block", F.shiftright("depth", BLOCK)), ["conv_id"], "block", {"top": F.max(top)})
    within = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    nodes = written(nodes.withColumn("top", F.coalesce(F.max(top).over(within), "top_before")).drop("top_before", "block"), "trie-runs")
    runs = nodes.where("heavy AND parent_conv_id != conv_id").select("conv_id", F.col("parent_conv_id").alias("head_conv"), (F.col("depth") - 1).alias("depth"))
    above = nodes.select(F.col("conv_id").alias("head_conv"), "depth", "top")
    runs = written(runs.join(above, ["head_conv", "depth"]).select("conv_id", "head_conv", "top"), "trie-pointers")
    while runs.where("top IS NULL").limit(1).count():
        on = runs.select(F.col("conv_id").alias("head_conv"), F.col("head_conv").alias("then_conv"), F.col("top").alias("then_top"))
        open_ = runs.where("top IS NULL").join(on, "head_conv").select("conv_id", F.col("then_conv").alias("head_conv"), F.col("then_top").alias("top"))
        runs = written(runs.where("top IS NOT NULL").unionAll(open_), "trie-pointers")
    runs = runs.withColumnRenamed("top", "far")
    open_ = nodes.where("top IS NULL").join(runs, "conv_id").withColumn("top", F.col("far")).drop("far")
    return nodes.where("top IS NOT NULL").withColumn("head_conv", F.col("conv_id")).unionByName(open_)


def subtree_sums(nodes: DataFrame, root) -> DataFrame:
    """Nodes with n_leaves and saved_tokens, by suffix sums along heavy paths, light paths before those that they hang from."""
    spark = nodes.sparkSession
    level = lambda n: (F.length(F.bin(n)) - 1).cast("int")  # the logarithm, rounded down, without fractions
    nodes = written(nodes.withColumn("level", level(F.col("top.n_convs"))), "trie-paths")
    is_head = (F.col("conv_id") == F.col("head_conv")) & (F.col("depth") == F.col("top.depth"))
    heads = nodes.where(is_head).where("depth > 0")
    of = nodes.where("n_children > 1 AND depth > 0").select(F.col("conv_id").alias("parent_conv_id"), (F.col("depth") + 1).alias("depth"), F.col("level").alias("target"))
    targets = heads.where("depth > 1").join(of, ["parent_conv_id", "depth"]).select("conv_id", "depth", "target")
    first = heads.where("depth = 1").select("conv_id", "depth", F.lit(root.n_convs.bit_length() - 1).alias("target"))
    nodes = written(nodes.join(targets.unionAll(first), ["conv_id", "depth"], "left"), "trie-levels")
    levels = sorted(r.level for r in nodes.select("level").distinct().collect())  # the logarithm of the conversations at most
    base, done = fresh_path(spark, "trie-sums"), []
    for k in levels:
        path = nodes.where(F.col("level") == k).withColumns({"leaves": (F.col("n_children") == 0).cast("long"), "tokens": (F.col("n_convs") - 1) * F.col("words")})
        light = [spark.read.schema(d.schema).parquet(d_path).where(F.col("target") == k) for d, d_path in done]
        if light:
            below = light[0]
            for more in light[1:]:
                below = below.unionAll(more)
            below = below.groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("t"))
            path = path.join(below, ["conv_id", "depth"], "left")
            path = path.withColumns({"leaves": F.col("leaves") + F.coalesce("l", F.lit(0)), "tokens": F.col("tokens") + F.coalesce("t", F.lit(0))})
        path = path.withColumns({"head_depth": F.col("top.depth"), "block": F.shiftright("depth", BLOCK)})
        owner = ["head_conv", "head_depth"]
        path = carried(path, owner, "block", {c: F.sum(c) for c in ("leaves", "tokens")}, backward=True)
        below = Window.partitionBy(*owner, "block").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
        sums = {new: F.sum(c).over(below) + F.coalesce(f"{c}_before", F.lit(0)) for c, new in (("leaves", "n_leaves"), ("tokens", "saved_tokens"))}
        out = path.withColumns(sums).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "k1", "k2", "target")
        out.write.partitionBy("target").parquet(f"{base}/{k}")  # read again by the paths that these hang from, no others
        done.append((out, f"{base}/{k}"))
    whole = [spark.read.schema(d.schema).parquet(p) for d, p in done]
    result = whole[0]
    for more in whole[1:]:
        result = result.unionAll(more)
    return result


def ends(rows: DataFrame, members: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256): the hash of the ids of the conversations that end there, in order.

    Ids are joined in chunks of neighbouring values, and the hash takes one chunk after another, so no node's ids are gathered.
    """
    last = rows.where("last").select(*KEY, "conv_id")
    none = members.where("size = 0").select(F.lit(0).cast("long").alias("depth"), *[F.lit(0).cast("long").alias(k) for k in ("k1", "k2")], "conv_id")
    some = last.unionAll(none).groupBy(*KEY, F.shiftright("conv_id", CHUNK).alias("chunk")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    some = some.select(*KEY, "chunk", F.concat_ws(",", F.transform("ids", lambda x: x.cast("string"))).alias("ids"))

    def run(batches):
        key, digest = None, None
        for batch in batches:
            out = []
            for *now, ids in zip(*(batch.column(c).to_pylist() for c in (*KEY, "ids")), strict=True):
                if now == key:
                    digest.update(b",")
                else:
                    if key is not None:
                        out.append((*key, digest.hexdigest()))
                    key, digest = now, hashlib.sha256()
                digest.update(ids.encode())
            yield table(out)
        if key is not None:
            yield table([(*key, digest.hexdigest())])

    def table(out):
        cols = list(zip(*out)) if out else [[]] * 4
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], [*KEY, "ends_sha256"])

    return some.repartition(*KEY).sortWithinPartitions(*KEY, "chunk").mapInArrow(run, "depth long, k1 long, k2 long, ends_sha256 string")


def trie(rows: DataFrame, members: DataFrame) -> DataFrame:
    """The nodes of conversations given as turns with depths and members with sizes, as ``plain_turns`` gives them."""
    spark = rows.sparkSession
    rows, members = written(keyed(rows), "trie-turns"), written(members, "trie-members")
    root = members.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id")).first()
    if not root.n_convs:
        types = dict.fromkeys(RESULT, "long") | {"ends_sha256": "string"}
        return spark.createDataFrame([], ", ".join(f"{c} {t}" for c, t in types.items()))
    nodes = rows.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("words").alias("words"), F.min("p1").alias("p1"), F.min("p2").alias("p2"))
    top = spark.createDataFrame([(0, 0, 0, root.conv_id, root.n_convs, 0, None, None)], nodes.schema)
    nodes = written(nodes.unionAll(top), "trie-nodes")
    sums = subtree_sums(with_paths(with_parents(nodes, root)), root)
    out = sums.join(ends(rows, members), KEY, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOTHING)))
    return out.select(*RESULT)


def conversation_trie(turns: DataFrame) -> DataFrame:
    """A row per distinct prefix of the conversations of ``turns`` (conv_id, turn, role, text): its smallest member and depth, its parent's smallest
    member, members, children, leaves below, words that storing it once saves over its subtree, and the hash of the members that end there."""
    return trie(*plain_turns(turns))


def op11(spark, sf_dir: str) -> DataFrame:
    return trie(*shared_beginnings(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")))


ORACLE = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, conv_id - conv_id % 20 AS head,
    xor(4294967295, list_reduce(list_concat([4294967295::BIGINT],
      flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) % 4 AS h
  FROM t GROUP BY conv_id),
r AS (
  SELECT c.conv_id, t.i, t.role, t.text, 0 AS own FROM c JOIN t ON t.conv_id = c.head AND t.i <= c.h
  UNION ALL SELECT c.conv_id, t.i, t.role, t.text, 1 FROM c JOIN t ON t.conv_id = c.conv_id AND t.i > c.h),
n AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY own, i) AS depth FROM r),
s AS (
  SELECT conv_id, depth, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words,
    string_agg(len(role) || ':' || role || len(text) || ':' || text, '') OVER (PARTITION BY conv_id ORDER BY depth) AS prefix FROM n),
k AS (SELECT conv_id, depth, words, sha256(prefix) AS key FROM s UNION ALL SELECT conv_id, 0, 0, '' FROM c),
ends AS (SELECT conv_id, max(depth) AS depth FROM k GROUP BY 1),
e AS (
  SELECT k.key, string_agg(k.conv_id::VARCHAR, ',' ORDER BY k.conv_id) AS ids FROM k JOIN ends USING (conv_id, depth) GROUP BY 1),
node AS (SELECT key, depth, min(conv_id) AS conv_id, count(*) AS n_convs, min(words) AS words FROM k GROUP BY 1, 2),
up AS (
  SELECT node.*, p.key AS parent, pn.conv_id AS parent_conv_id FROM node LEFT JOIN k p ON p.conv_id = node.conv_id AND p.depth = node.depth - 1
  LEFT JOIN node pn ON pn.key = p.key),
kids AS (SELECT parent AS key, count(*) AS n_children FROM up WHERE parent IS NOT NULL GROUP BY 1),
v AS (SELECT up.*, coalesce(n_children, 0) AS n_children FROM up LEFT JOIN kids USING (key)),
below AS (
  SELECT k.key, count(*) FILTER (WHERE v.n_children = 0) AS n_leaves, sum((v.n_convs - 1) * v.words)::BIGINT AS saved_tokens
  FROM v JOIN k ON k.conv_id = v.conv_id AND k.depth <= v.depth GROUP BY 1)
SELECT v.conv_id, v.depth, v.parent_conv_id, v.n_convs, v.n_children, below.n_leaves, below.saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM v JOIN below USING (key) LEFT JOIN e USING (key)
"""
