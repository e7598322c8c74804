"""Plot data of attributions: beeswarms, and dependence with the interacting feature."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranking import top_k
from ..sources.sinks import cut_lineage
from .consensus import mean_abs

BINS = 10


def top_features(shap: DataFrame, k: int) -> DataFrame:
    """(feature) of the largest mean attributions."""
    return top_k(mean_abs(shap), [], "mean_abs_shap", k).select("feature")


def beeswarm(shap: DataFrame, long: DataFrame, k: int = 20) -> DataFrame:
    """(id, feature, value, shap) of the ``k`` features of the largest mean attributions."""
    own = shap.join(F.broadcast(top_features(shap, k)), "feature")  # k rows
    return own.join(long.select("id", "feature", "value"), ["id", "feature"]).select("id", "feature", "value", "shap")


def interactions(shap: DataFrame, long: DataFrame, k: int = 3, bins: int = BINS) -> DataFrame:
    """(feature, other, strength): how closely the attributions of each top feature follow another
    feature's value among rows of like value of its own.

    Rows are cut into ``bins`` by the top feature's value; in each, the absolute correlation of its
    attribution with the other value counts by its rows, and 0 where one of them is constant."""
    own = beeswarm(shap, long, k)
    order = Window.partitionBy("feature").orderBy("value", "id")
    n = F.count("*").over(Window.partitionBy("feature"))
    own = own.withColumn("bin", F.floor((F.row_number().over(order) - 1) * bins / n).cast("int"))
    others = long.select("id", F.col("feature").alias("other"), F.col("value").alias("other_value"))
    pairs = own.join(others, "id").where("feature <> other")
    one, two = F.stddev_pop("shap"), F.stddev_pop("other_value")
    rho = F.when((one > 1e-12) & (two > 1e-12), F.abs(F.covar_pop("shap", "other_value")) / F.nullif(one * two, F.lit(0.0))).otherwise(0.0)
    each = pairs.groupBy("feature", "other", "bin").agg(F.count("*").alias("n"), rho.alias("rho"))
    return each.groupBy("feature", "other").agg((F.sum(F.col("n") * F.col("rho")) / F.sum("n")).alias("strength"))


def dependence(shap: DataFrame, long: DataFrame, k: int = 3, bins: int = BINS) -> DataFrame:
    """(feature, id, value, shap, interaction, interaction_value) of the ``k`` top features; the
    interaction is that of the largest strength, the smaller name among equals to nine places."""
    shap, long = cut_lineage(shap), cut_lineage(long.select("id", "feature", "value"))
    strength = interactions(shap, long, k, bins).withColumn("strength", F.round("strength", 9))
    chosen = top_k(strength, ["feature"], "strength", 1, "other").select("feature", F.col("other").alias("interaction"))
    rows = beeswarm(shap, long, k).join(F.broadcast(chosen), "feature")  # k rows
    beside = long.select("id", F.col("feature").alias("interaction"), F.col("value").alias("interaction_value"))
    return rows.join(beside, ["id", "interaction"]).select("feature", "id", "value", "shap", "interaction", "interaction_value")
