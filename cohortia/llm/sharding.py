"""Jump consistent hashing: stable keys to shards without a ring table.

The jump sequence of a key depends on the key alone; its shard is the last jump below
the shard count. Appending shards therefore moves only the keys whose sequence lands in a
new shard, about ``1 / n`` of the rows. (Lamping and Veach, 2014; the uniform variate of
each jump is a hash of key and position instead of a step of a linear generator, as Spark's
ANSI arithmetic doesn't wrap.)

Cases: a null key is a key of its own; a null text has no bytes (size 1, CRC-32 0); repeated
rows share a shard and get different slots; very long texts are rows like others, of which
only size and checksum are shuffled; integers of any width hash alike, but other types (texts
of digits) hash to other shards; an empty table gives no rows; further columns, whatever their
names, are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, whole_text

#: A key makes about ln(n) jumps; beyond this many shards the loop is no longer n steps long, and
#: a key with more jumps (odds under 1e-40 for a million shards) is an error, never a wrong shard.
MOST_STEPS = 96


def jump_shard(key: Column, n_shards: int) -> Column:
    """Shard of each key, 0 to ``n_shards - 1``, by built-in expressions only."""
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    steps = min(n_shards, MOST_STEPS)
    start = F.struct(F.lit(-1).cast("bigint").alias("b"), F.lit(0).cast("bigint").alias("j"))

    def jump(state: Column, _: Column) -> Column:
        inside = state["j"] < n_shards
        u = (F.shiftrightunsigned(F.xxhash64(key, state["j"]), 33) + 1).cast("double")
        to = F.floor((state["j"] + 1) * (F.lit(float(1 << 31)) / u))
        return F.struct(
            F.when(inside, state["j"]).otherwise(state["b"]).alias("b"),
            F.when(inside, to).otherwise(state["j"]).alias("j"),
        )

    def ended(s: Column) -> Column:
        return F.when(s["j"] >= n_shards, s["b"]).otherwise(F.raise_error(F.lit(f"a key has more than {steps} jumps")).cast("bigint"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, jump, ended).cast("int")


def shard_documents(
    docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text", rows_per_bucket: int = 25_000
) -> DataFrame:
    """Shard, gapless slot in the shard, and the shard if there were one more.

    A shard may hold any share of the table, so slots aren't numbered by one task a shard: rows
    equal in id, size and checksum are counted first, before the shuffle; those groups are numbered
    inside (shard, hash bucket) groups of about ``rows_per_bucket / n_shards`` rows, prefix sums of
    the bucket counts give where each starts, and equal rows take the following slots each.
    """
    n = docs.count()
    buckets = max(1, math.ceil(n / rows_per_bucket))
    text = whole_text(text_col)
    key = F.col("doc_id")
    if docs.schema[id_col].dataType.simpleString() in ("tinyint", "smallint", "int"):
        key = key.cast("bigint")
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"))
    equal = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("m")).withColumns(
        {
            "shard": jump_shard(key, n_shards),
            "grown_shard": jump_shard(key, n_shards + 1),
            "bucket": F.pmod(F.xxhash64(key, F.lit("bucket"), "size", "text_crc32"), F.lit(buckets)).cast("int"),
        }
    )
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = equal.groupBy("shard", "bucket").agg(F.sum("m").alias("count"))
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    return (
        equal.withColumn("at", F.coalesce(F.sum("m").over(inside), F.lit(0)))
        .join(starts, ["shard", "bucket"])
        .withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("m") - 1)))
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("key").alias("law"),
            "shard",
            (F.col("start") + F.col("at") + F.col("copy")).cast("bigint").alias("slot"),
            "grown_shard",
        )
    )


def op7_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), n_shards=8)
