"""Jaccard self-join of n-gram sets by prefixes under several global orders of the n-grams.

Put the n-grams of all sets in any one order: sets that overlap by ``percent`` share k n-grams among
the first ``n - ceil(percent n / 100) + k`` of each (its prefix), whatever k. That holds for every
order, so linked sets share prefix n-grams under each of three:

1. by hash. It needs no statistics, so all sets take part, with k a tenth of n: those that share
   fewer than k of a quarter of their n-grams with any others retire;
2. of the sets that are left, by number of sets that hold the n-gram, then by hash: n-grams of one
   set come first and can't be shared, so a set with enough of them retires;
3. by the same number, then by another hash.

Shared prefix n-grams of one order make components; those are cut by the shared prefix n-grams of
the next order inside each component, and again by the third. A link survives every cut, as its
sets share a prefix n-gram each time. What is left is confirmed on full sets as near duplicates
are (``near_dup.resolved``): inverted indexes of blocks, strays against every block.

No pair is made before confirmation: an n-gram's sets are tied to their smallest, by counts that
are combined before the shuffle and ``with_group``, so an n-gram of a third of all sets is no
crowd. Equal sets are one member from the start. No statistic is broadcast.

Cases: null and empty texts have no n-grams and are linked with nothing; texts with fewer words than
an n-gram are one n-gram, linked with equal ones only; texts of equal sets are linked, whatever
their word order; a doc_id with several texts is several documents, each linked for itself; rows
repeated in full get one answer each; a null doc_id is linked with nothing (component_id null);
ties don't matter, as a component is named by its smallest doc_id; very long texts are read
whole; an empty table gives no rows; further columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bloom import possible
from .common import forget, handing_back, table, written
from .components import components
from .groups import with_group
from .near_dup import resolved, shingle_set, text_hash, words_of

#: Texts whose sets are held at once.
ROWS = 128


def prefix_length(n: Column | int, percent: int, k: Column | int = 1) -> Column | int:
    """How many n-grams of a set of n, from its first on, any linked set shares k of at least."""
    if isinstance(n, Column):
        return n - F.ceil(n * percent / 100) + k
    return n - -(-percent * n // 100) + k


def least_shared(n: Column | int) -> Column | int:
    """k of the first order: a tenth of n, one at least."""
    return F.greatest(F.lit(1), F.floor(n / 10)) if isinstance(n, Column) else max(1, n // 10)


def _sets(batches: Iterator[pd.DataFrame], gram: int) -> Iterator[tuple[pd.DataFrame, list[np.ndarray]]]:
    for batch in batches:
        for start in range(0, len(batch), ROWS):
            rows = batch.iloc[start : start + ROWS]
            yield rows, [shingle_set(words_of(t), gram).view(np.int64) for t in rows["text"]]


def sets_by_hash(docs: DataFrame, gram: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, h (hash of the text), seq (128-bit hash of the set), n (its size), low (its prefix by hash)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, sets in _sets(batches, gram):
            n = np.fromiter(map(len, sets), np.int64, len(sets))
            low = [s[: prefix_length(len(s), percent, least_shared(len(s)))] if len(s) else s for s in sets]
            seq = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            yield pd.DataFrame({"doc_id": rows["doc_id"].to_numpy(object), "h": rows["h"].to_numpy(), "seq": seq, "n": n, "low": low})

    rows = docs.select(F.col(id_col).alias("doc_id"), text_hash(text_col).alias("h"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInPandas(handing_back(run), f"doc_id {kind}, h bigint, seq binary, n bigint, low array<bigint>")


def full_sets(docs: DataFrame, members: DataFrame, gram: int, id_col: str, text_col: str) -> DataFrame:
    """u, t: every n-gram of ``members`` (u, first, h)."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("first"), text_hash(text_col).alias("h"), F.col(text_col).cast("binary").alias("text")).where("first is not null")
    rows = possible(rows, F.xxhash64("first", "h"), members.select(F.xxhash64("first", "h").alias("key")), "key", members.count())
    # rows repeated in full are one before they meet
    rows = rows.dropDuplicates(["first", "h"]).join(members.select("u", "first", "h"), ["first", "h"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, sets in _sets(batches, gram):
            yield pd.DataFrame({"u": rows["u"].to_numpy(), "t": sets})

    return rows.select("u", "text").mapInPandas(handing_back(run), "u bigint, t array<bigint>").select("u", F.explode("t").alias("t"))


def _shared(grams: DataFrame) -> DataFrame:
    """t, n (sets that hold it, two at least)."""
    return written(grams.groupBy("t").agg(F.count("*").alias("n")).where("n > 1"), "shared")


def _counted(grams: DataFrame, shared: DataFrame, total: int) -> DataFrame:
    """Rows of ``grams`` whose t is shared, with n."""
    return with_group(grams, shared, ["t"], total).where("n is not null")


def by_rarity(grams: DataFrame, members: DataFrame, total: int, percent: int) -> DataFrame:
    """u, rare, other: prefixes by (number of sets, hash) and (number of sets, another hash), without
    n-grams of one set; members whose prefix has no others are left out."""
    shared = _shared(grams)
    own = _counted(grams, shared, total).groupBy("u").agg(F.collect_list(F.struct("n", "t")).alias("s"))  # at most a text's n-grams
    own = own.join(members.select("u", F.col("n").alias("size")), "u")
    room = (prefix_length(F.col("size"), percent) - (F.col("size") - F.size("s"))).cast("int")
    rehashed = F.transform("s", lambda x: F.struct(x["n"].alias("n"), F.xxhash64(x["t"]).alias("k"), x["t"].alias("t")))
    first = lambda s: F.slice(F.sort_array(s), F.lit(1), F.col("room"))["t"]
    return own.withColumn("room", room).where("room > 0").select("u", first(F.col("s")).alias("rare"), first(rehashed).alias("other"))


def cut(members: DataFrame, prefix: str) -> DataFrame:
    """``members`` (u, cluster, ...) by components of those of one cluster that share n-grams of a prefix."""
    grams = members.select("u", "cluster", F.explode(prefix).alias("t"))
    least = grams.groupBy("cluster", "t").agg(F.min("u").alias("a"), F.count("*").alias("n")).where("n > 1")
    total = members.agg(F.sum(F.size(prefix))).first()[0] or 0
    edges = with_group(grams, written(least, "ties"), ["cluster", "t"], total).where("a <> u").select("a", F.col("u").alias("b")).distinct()
    found = components(edges).withColumnsRenamed({"vertex": "u", "component": "cluster"})
    return written(members.drop("cluster").join(found, "u"), "cut")


def clusters_of(docs: DataFrame, members: DataFrame, gram: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(u, cluster) of ``members`` (u, first, h, n, low), inside which all links lie; others have none."""
    low = members.select("u", F.explode("low").alias("t"))
    total = members.agg(F.sum(F.size("low"))).first()[0] or 0
    met = _counted(low, _shared(low), total).groupBy("u").agg(F.count("*").alias("met"))
    left = members.join(met, "u").where(F.col("met") >= least_shared(F.col("n"))).drop("met")
    left = written(left.withColumn("low", F.slice("low", F.lit(1), prefix_length(F.col("n"), percent).cast("int"))), "left")
    members = left
    grams = written(full_sets(docs, members, gram, id_col, text_col), "grams")
    total = members.agg(F.sum("n")).first()[0] or 0
    ranked = by_rarity(grams, members, total, percent).join(members.select("u", "low"), "u")
    now = written(ranked.withColumn("cluster", F.lit(0).cast("bigint")), "ranked")
    forget(docs.sparkSession, left, grams)
    for prefix in ("rare", "low", "other"):
        now = cut(now, prefix)
    return now.select("u", "cluster")


def prefix_join(docs: DataFrame, gram: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for each row of ``docs`` (doc_id: an integer).

    Links are ``100 * |A & B| >= percent * |A | B|``, confirmed on full sets."""
    signed = written(sets_by_hash(docs, gram, percent, id_col, text_col), "signed")
    first = F.min(F.struct(F.col("doc_id").cast("bigint").alias("doc_id"), "h", "n", "low")).alias("x")
    members = signed.where("n > 0 and doc_id is not null").groupBy("seq").agg(first)
    # numbers are written with the rows: whatever a retried task does, one number is one set
    members = written(members.select("seq", F.monotonically_increasing_id().alias("u"), F.col("x.doc_id").alias("first"), "x.h", "x.n", "x.low"), "members")
    clusters = clusters_of(docs, members, gram, percent, id_col, text_col)
    return resolved(docs, signed.drop("low"), members, clusters, gram, percent, id_col, text_col).drop("h", "kept")


def op13_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_join(table(spark, sf_dir, "documents"), gram=4, percent=85)
