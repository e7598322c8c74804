"""The trie of conversation prefixes by partition refinement.

All conversations start in one class, the textless root. Each round splits the classes that are
still active by their members' next turn; a class is named by its smallest member. A class of
one member is retired: the rest of that conversation is a unary chain, which is emitted from
its own row at the end and meets no further shuffle. Folding back goes from the deepest round to
the root: children are summed by parent, so leaves and savings of subtrees come up one level a
round. There are as many rounds as the longest shared prefix has turns.

A turn is its role and text as a 128-bit digest and a word count, so that texts are read once and
never shuffled; a conversation's digests are one row (some 30 bytes a turn). Members learn their
class by ``with_group``, as one turn may begin a third of all conversations. The ids that end in
one node are hashed from sorted chunks, made by tasks that each hold a range of them.

Cases: turns are ordered by turn (null first), then role, then digest of the text; a null role or
text is empty; rows repeated in full are turns of their own; rows without a conv_id belong to no
conversation and are left out; very long texts are read whole; an empty table has no nodes;
further columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, handing_back, table, written
from .corpus_sql import CRC_TABLE, crc32_sql
from .groups import with_group

WORD = r"[^\x20\x09-\x0D]+"
NO_ENDS = hashlib.sha256(b"").hexdigest()


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, turns (array of k, the digest of role and text, and w, the words of the text)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", role.alias("role"), F.md5(text).alias("m"), F.regexp_count(text, F.lit(WORD)).alias("w")
    )
    ordered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "m", "w"))).alias("t"))
    turn = lambda x: F.struct(F.unhex(F.md5(F.concat(F.md5(x["role"]), x["m"]))).alias("k"), x["w"].alias("w"))
    return ordered.select("conv_id", F.transform("t", turn).alias("turns"))


def rebuilt(turns: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """Conversations whose first h turns, h under ``most`` by checksum of the id, are those of the
    conversation at the last multiple of ``every``."""
    heads = turns.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    rows = turns.withColumns({"base": F.col("conv_id") - F.col("conv_id") % every, "h": h}).join(heads, "base", "left")
    head = F.slice(F.coalesce("head", F.slice("turns", 1, 0)), F.lit(1), F.col("h"))
    return rows.select("conv_id", F.concat(head, F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("turns"))


def _split(active: DataFrame, total: int) -> DataFrame:
    """Members of active classes one turn on: conv_id, parent, cls, n (of the class), w, rest."""
    first = F.col("rest")[0]
    moved = active.select("conv_id", F.col("cls").alias("parent"), first["k"].alias("k"), first["w"].alias("w"), F.slice("rest", F.lit(2), F.size("rest")).alias("rest"))
    classes = moved.groupBy("parent", "k").agg(F.min("conv_id").alias("cls"), F.count("*").alias("n"))
    found = with_group(moved, classes, ["parent", "k"], total)
    return found.select("conv_id", "parent", F.coalesce("cls", "conv_id").alias("cls"), F.coalesce("n", F.lit(1)).alias("n"), "w", "rest")


def refined(conversations: DataFrame) -> list[DataFrame]:
    """Of each depth, the members of the classes split to it: conv_id, parent, cls, n, w, rest."""
    total, least = conversations.agg(F.count("*"), F.min("conv_id")).first()
    if not total:
        return []
    root = conversations.select(
        "conv_id", F.lit(None).cast("bigint").alias("parent"), F.lit(least).cast("bigint").alias("cls"), F.lit(total).cast("bigint").alias("n"), F.lit(0).alias("w"), F.col("turns").alias("rest")
    )
    levels = [written(root, "trie")]
    while True:
        active = levels[-1].where((F.col("n") > 1) & (F.size("rest") > 0))
        if not (total := active.count()):
            return levels
        levels.append(written(_split(active, total), "trie"))


def ends_of(rows: DataFrame) -> DataFrame:
    """(depth, cls, ends): hashes of the comma-joined ids, in order, of rows (depth, cls, conv_id)."""

    def chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = batch.groupby(["depth", "cls"], sort=False)["conv_id"]
            yield own.agg(first="first", ids=lambda x: ",".join(map(str, x))).reset_index()

    def hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, h = None, hashlib.sha256()
        for batch in batches:
            done = []
            for depth, cls, ids in batch[["depth", "cls", "ids"]].itertuples(index=False):
                if now == (depth, cls):
                    h.update(b"," + ids.encode())
                    continue
                if now:
                    done.append((*now, h.hexdigest()))
                now, h = (depth, cls), hashlib.sha256(ids.encode())
            yield pd.DataFrame(done, columns=["depth", "cls", "ends"])
        if now:
            yield pd.DataFrame([(*now, h.hexdigest())], columns=["depth", "cls", "ends"])

    ranges = rows.repartitionByRange("depth", "cls", "conv_id").sortWithinPartitions("depth", "cls", "conv_id")
    parts = ranges.mapInPandas(handing_back(chunks), "depth int, cls bigint, first bigint, ids string")
    return parts.repartition("depth", "cls").sortWithinPartitions("depth", "cls", "first").mapInPandas(handing_back(hashes), "depth int, cls bigint, ends string")


def _chains(level: DataFrame, depth: int) -> DataFrame:
    """Nodes of the retired classes of a level: the class and the rest of its only member."""
    at = level.where("n = 1").select("conv_id", "parent", F.size("rest").alias("left"), F.explode(F.sequence(F.lit(0), F.size("rest"))).alias("i"))
    last = F.col("i") == F.col("left")
    return at.select(
        (F.lit(depth) + F.col("i")).alias("depth"),
        "conv_id",
        F.when(F.col("i") == 0, F.col("parent")).otherwise(F.col("conv_id")).alias("parent"),
        F.lit(1).cast("bigint").alias("n"),
        F.when(last, 0).otherwise(1).cast("bigint").alias("n_children"),
        F.lit(1).cast("bigint").alias("n_leaves"),
        F.lit(0).cast("bigint").alias("saved_tokens"),
        F.when(last, F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(F.lit(NO_ENDS)).alias("ends_sha256"),
    )


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _folded(levels: list[DataFrame]) -> DataFrame:
    """Nodes of the classes of two members at least, with their subtrees' sums."""
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    below, nodes = None, []
    for depth in reversed(range(len(levels))):
        tops = levels[depth].where("conv_id = cls").select(F.lit(depth).alias("depth"), "conv_id", "parent", "n", "w")
        wide = tops.where("n > 1")
        if below is None:
            wide = wide.withColumns({c: F.lit(None).cast("bigint") for c in ("children", "leaves", "saved")})
        else:
            wide = wide.join(below.withColumnRenamed("parent", "conv_id"), "conv_id", "left")
        saved = ((F.col("n") - 1) * F.col("w") + count("saved")).alias("saved_tokens")
        wide = wide.select("depth", "conv_id", "parent", "n", count("children").alias("n_children"), F.coalesce("leaves", F.lit(1)).cast("bigint").alias("n_leaves"), saved)
        nodes.append(written(wide, "nodes"))
        alone = tops.where("n = 1").select("parent", F.lit(1).cast("bigint").alias("n_leaves"), F.lit(0).cast("bigint").alias("saved_tokens"))
        up: list[Column] = [F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")]
        below = nodes[-1].select(*alone.columns).unionByName(alone).groupBy("parent").agg(*up)
    return _union(nodes)


def trie(conversations: DataFrame) -> DataFrame:
    """A row for each node of rows (conv_id, turns): conv_id (smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    levels = refined(conversations)
    if not levels:
        kinds = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
        return conversations.sparkSession.createDataFrame([], kinds)
    wide = _folded(levels)
    ended = _union([x.where((F.col("n") > 1) & (F.size("rest") == 0)).select(F.lit(d).alias("depth"), "cls", "conv_id") for d, x in enumerate(levels)])
    ends = ends_of(ended).withColumnRenamed("cls", "conv_id")
    wide = wide.join(ends, ["depth", "conv_id"], "left").withColumn("ends_sha256", F.coalesce("ends", F.lit(NO_ENDS))).drop("ends")
    nodes = wide.unionByName(_union([_chains(x, d) for d, x in enumerate(levels)]))
    return nodes.select(
        "conv_id", F.col("depth").cast("bigint").alias("depth"), F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = written(turns_of(table(spark, sf_dir, "conversations")), "turns")
    nodes = trie(rebuilt(turns))
    return nodes


OP11_SQL = f"""WITH {CRC_TABLE},
r AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS k,
  md5(coalesce(role, '')) || md5(coalesce(text, '')) AS t, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS w FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS base, {crc32_sql("CAST(conv_id AS VARCHAR)")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM r) CROSS JOIN crc),
b AS (SELECT c.conv_id, 0 AS part, k, t, w FROM c JOIN r ON r.conv_id = base AND k <= h UNION ALL SELECT c.conv_id, 1, k, t, w FROM c JOIN r ON r.conv_id = c.conv_id AND k > h),
o AS (SELECT conv_id, t, w, row_number() OVER (PARTITION BY conv_id ORDER BY part, k) AS depth FROM b),
p AS (SELECT conv_id, depth, w, string_agg(t, '') OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM o UNION ALL SELECT conv_id, 0, 0, '' FROM c),
m AS (SELECT *, min(conv_id) OVER (PARTITION BY depth, path) AS node, count(*) OVER (PARTITION BY depth, path) AS n, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM p),
x AS (SELECT node, depth, any_value(n) AS n, any_value(w) AS w, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '') AS ids FROM m GROUP BY node, depth),
y AS (SELECT x.*, m.node AS parent FROM x LEFT JOIN m ON m.conv_id = x.node AND m.depth = x.depth - 1),
k AS (SELECT parent, depth - 1 AS depth, count(*) AS kids FROM y WHERE depth > 0 GROUP BY ALL),
z AS (SELECT y.*, coalesce(kids, 0) AS kids FROM y LEFT JOIN k ON k.parent = y.node AND k.depth = y.depth),
s AS (SELECT m.node, m.depth, sum((z.n - 1) * z.w) AS saved, count(*) FILTER (z.kids = 0) AS leaves FROM z JOIN m ON m.conv_id = z.node AND m.depth <= z.depth GROUP BY ALL)
SELECT z.node AS conv_id, z.depth, z.parent AS parent_conv_id, z.n AS n_convs, z.kids AS n_children, s.leaves AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(z.ids) AS ends_sha256
FROM z JOIN s ON s.node = z.node AND s.depth = z.depth"""
