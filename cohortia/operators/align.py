"""Alignment of blocks, labels and results by entity id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class AlignmentError(ValueError):
    pass


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """Raise if a key occurs twice: normalizing ids may have merged two entities."""
    if twice := duplicates(df, keys).take(1):
        raise AlignmentError(f"repeated key {twice[0].asDict()}")
    return df


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def align_blocks(long: DataFrame, n_blocks: int) -> DataFrame:
    """Rows of the ids that every block has."""
    ids = long.groupBy("id").agg(F.countDistinct("block").alias("n")).where(F.col("n") == n_blocks).select("id")
    return long.join(ids, "id", "left_semi")


def with_labels(long: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows with a label that isn't missing."""
    return long.join(labels.where("label is not null"), "id")


def with_batch(ids: DataFrame, batch: DataFrame) -> DataFrame:
    return ids.join(batch, "id", "left")


def pair_results(one: DataFrame, two: DataFrame) -> DataFrame:
    """id, y, a, b of the ids in both; raises where the labels disagree."""
    joined = one.select("id", F.col("y").alias("ya"), F.col("p").alias("a")).join(two.select("id", F.col("y").alias("yb"), F.col("p").alias("b")), "id")
    if joined.where("not (ya <=> yb)").take(1):
        raise AlignmentError("the two sources disagree about labels")
    return joined.select("id", F.col("ya").alias("y"), "a", "b")


def add_filled(tables: list[DataFrame], key: str, value: str) -> DataFrame:
    """Sum over tables, a missing key counting as 0."""
    every = tables[0]
    for t in tables[1:]:
        every = every.unionByName(t)
    return every.groupBy(key).agg(F.sum(value).alias(value))


def wide(long: DataFrame) -> tuple[DataFrame, list[str]]:
    """(id, x array<double> in the order of the returned names). The names are one row a feature."""
    names = [r["feature"] for r in long.select("feature").distinct().orderBy("feature").toLocalIterator()]
    cells = F.map_from_entries(F.collect_list(F.struct("feature", "value")))
    packed = long.groupBy("id").agg(cells.alias("m"))
    return packed.select("id", F.array(*[F.col("m")[n] for n in names]).alias("x")), names
