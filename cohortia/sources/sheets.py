"""Readers: CSV and Parquet exports of sheets, some with entities in columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import clean_label, normalize_id, parse_decimal


def read_text_table(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, every cell text: nothing is inferred."""
    return spark.read.csv(path, header=True, inferSchema=False)


def drop_last(df: DataFrame, n: int) -> DataFrame:
    return df.select(*df.columns[: len(df.columns) - n]) if n else df


def transposed(df: DataFrame, name: str = "feature") -> DataFrame:
    """(entity, feature, raw) from a sheet with one row a feature and one column an entity."""
    first, *entities = df.columns
    return df.select(F.trim(F.col(first)).alias(name), *[F.col(f"`{c}`").cast("string") for c in entities]).unpivot(
        [name], entities, "entity", "raw"
    )


def upright(df: DataFrame, name: str = "feature") -> DataFrame:
    """(entity, feature, raw) from a sheet with one row an entity."""
    first, *features = df.columns
    return df.select(F.col(f"`{first}`").cast("string").alias("entity"), *[F.col(f"`{c}`").cast("string") for c in features]).unpivot(
        ["entity"], features, name, "raw"
    )


def feature_block(cells: DataFrame, block: str) -> DataFrame:
    """Long form: id, block, feature (with the block as prefix), value. Both blocks are read as
    numbers with comma or point."""
    return cells.select(
        normalize_id(F.col("entity")).alias("id"),
        F.lit(block).alias("block"),
        F.concat(F.lit(f"{block}__"), F.trim("feature")).alias("feature"),
        parse_decimal(F.col("raw")).alias("value"),
    )


def attribute(cells: DataFrame, key: str, column: str, out: str) -> DataFrame | None:
    """(id, out) of one attribute of a transposed metadata sheet; None if it isn't there."""
    if not cells.where(F.col("feature") == column).limit(1).count():
        return None
    wide = cells.groupBy("entity").pivot("feature", [key, column]).agg(F.first("raw", ignorenulls=True))
    return wide.select(normalize_id(F.col(f"`{key}`")).alias("id"), clean_label(F.col(f"`{column}`")).alias(out))


def read_results(spark: SparkSession, path: str, schema: str, format: str = "parquet") -> DataFrame:
    """A result table with its declared schema, so that a null stays a null."""
    reader = spark.read.schema(schema)
    return reader.csv(path, header=True) if format == "csv" else reader.parquet(path)


def artifacts(spark: SparkSession, rows: Sequence[tuple[str, str, str, str]]) -> DataFrame:
    """Catalog of written tables: run, kind, model, path. Looked up by key, not by file name."""
    return spark.createDataFrame(list(rows), "run string, kind string, model string, path string")


def artifact_path(catalog: DataFrame, run: str, kind: str, model: str) -> str:
    found = catalog.where((F.col("run") == run) & (F.col("kind") == kind) & (F.col("model") == model)).select("path").take(2)
    if len(found) != 1:
        raise FileNotFoundError(f"{len(found)} tables of kind {kind} for model {model} in run {run}")
    return found[0]["path"]
