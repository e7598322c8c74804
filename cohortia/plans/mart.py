"""The driver's tables as a study: entities, two feature blocks, labels, batches, scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import resample
from ..operators.align import align_blocks

SEED, FOLDS = 42, 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def imaging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, feature, value): per customer aggregates of orders and line items."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber")
    q, p, d, t = (F.col(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax"))
    wide = orders.join(items, orders.o_orderkey == items.l_orderkey).groupBy(F.col("o_custkey").cast("string").alias("id")).agg(
        F.count("*").cast("double").alias("rad__n_items"),
        F.countDistinct("o_orderkey").cast("double").alias("rad__n_orders"),
        F.round(F.sum(q), 4).alias("rad__quantity_sum"),
        F.round(F.avg(q), 6).alias("rad__quantity_mean"),
        F.round(F.max(p), 4).alias("rad__price_max"),
        F.round(F.sum(p), 2).alias("rad__price_sum"),
        F.round(F.min(p), 4).alias("rad__shape_price_min"),
        F.round(F.avg(d), 6).alias("rad__Shape_discount_mean"),
        F.round(F.avg(t), 6).alias("rad__tax_mean"),
        F.max("l_linenumber").cast("double").alias("rad__shape_lines_max"),
    )
    features = [c for c in wide.columns if c != "id"]
    return wide.unpivot("id", features, "feature", "value")


def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, feature, value): per user aggregates of events by type; a type without events counts 0."""
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "value")
    own = events.groupBy("user_id", "event_type").agg(F.count("*").cast("double").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.max("value"), 4).alias("top"))
    grid = events.select("user_id").distinct().join(events.select("event_type").distinct())
    rows = grid.join(own, ["user_id", "event_type"], "left").select(
        F.col("user_id").cast("string").alias("id"), "event_type", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("n", "total", "top")]
    )
    long = rows.unpivot(["id", "event_type"], ["n", "total", "top"], "what", "value")
    return long.select("id", F.concat(F.lit("gen__"), "event_type", F.lit("_"), "what").alias("feature"), "value")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, block, feature, value) of both blocks, unaligned."""
    return imaging(spark, sf_dir).withColumn("block", F.lit("rad")).unionByName(genes(spark, sf_dir).withColumn("block", F.lit("gen"))).select("id", "block", "feature", "value")


def aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_blocks(blocks(spark, sf_dir), 2)


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, label): the customer's market segment."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_mktsegment").alias("label"))


def binary_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels(spark, sf_dir).select("id", (F.col("label") == "BUILDING").cast("int").alias("y"))


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, batch): the customer's nation; some nations have no name here, so rows stay without one."""
    nation = table(spark, sf_dir, "nation").where("n_nationkey % 5 <> 0").select("n_nationkey", "n_name")
    return table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").cast("string").alias("id"), F.col("n_name").alias("batch"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, feature, value) of the embeddings: 64 complete features."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.posexplode("embedding").alias("i", "v"))
    return e.select("id", F.concat(F.lit("f"), F.lpad(F.col("i").cast("string"), 2, "0")).alias("feature"), F.col("v").cast("double").alias("value"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, y, fold, grp, a, b): two fixed linear scores with ties, and stratified folds."""
    x = lambda i: F.col("embedding")[i].cast("double")
    mean = lambda lo: F.floor(sum((x(i) for i in range(lo + 1, lo + 8)), x(lo)) / 8 * 500) / 500
    rows = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("id"), (F.col("label") < 5).cast("int").alias("y"), F.col("label").alias("grp"), mean(0).alias("a"), mean(8).alias("b")
    )
    return resample.stratified_folds(rows, FOLDS, SEED)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model, id, fold, y, p, pred) of the two scores, positive where over 0."""
    long = scored(spark, sf_dir).unpivot(["id", "fold", "y"], ["a", "b"], "model", "p")
    return long.withColumn("pred", (F.col("p") > 0).cast("int")).select("model", "id", "fold", "y", "p", "pred")


def vector_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("id"), (F.col("label") < 5).cast("int").alias("y"))


def fold_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fold, feature, mean, sd, importance): a linear model by class means of standardized
    training rows, for each outer fold."""
    folds = resample.stratified_folds(vector_labels(spark, sf_dir), FOLDS, SEED)
    rows = vectors(spark, sf_dir).join(folds, "id").withColumn("outer", F.explode(F.sequence(F.lit(0), F.lit(FOLDS - 1)))).where("outer <> fold")
    own = lambda y: F.avg(F.when(F.col("y") == y, F.col("value")))
    s = rows.groupBy(F.col("outer").alias("fold"), "feature").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"), own(1).alias("m1"), own(0).alias("m0"))
    sd = F.when(F.col("sd") > 0, F.col("sd")).otherwise(F.lit(1.0))
    return s.select("fold", "feature", "mean", sd.alias("sd"), ((F.col("m1") - F.col("m0")) / sd).alias("importance"))
