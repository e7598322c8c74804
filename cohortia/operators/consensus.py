"""Feature importances across folds, resamples and specifications."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranking import normalized_rank, top_k
from ..functions.scalars import present

TINY = 1e-8


def feature_stats(importances: DataFrame, by: list[str], signed: bool = True) -> DataFrame:
    """by..., feature and six statistics of its importance over folds."""
    x = F.col("importance")
    share = lambda c: F.avg(c.cast("double"))
    return importances.groupBy(*by, "feature").agg(
        F.avg(x).alias("mean_coefficient"),
        F.stddev_samp(x).alias("std_coefficient"),
        F.avg(F.abs(x)).alias("mean_abs_coefficient"),
        share(F.abs(x) > TINY).alias("fraction_nonzero"),
        (share(x > TINY) if signed else F.lit(None).cast("double")).alias("fraction_positive"),
        (share(x < -TINY) if signed else F.lit(None).cast("double")).alias("fraction_negative"),
    )


def collapsed(stats: DataFrame, by: list[str]) -> DataFrame:
    """Whether a model used no feature in any fold."""
    return stats.groupBy(*by).agg(F.bool_and(F.col("fraction_nonzero") == 0).alias("collapsed_model"))


def stability(importances: DataFrame, by: list[str], top: int, n_bootstrap: int) -> DataFrame:
    """(feature, selection_frequency): share of all resamples, degenerate ones included in the
    denominator, in which a feature is among the top."""
    chosen = top_k(importances.withColumn("_i", F.abs("importance")), by, "_i", top)
    return chosen.groupBy("feature").agg((F.count("*") / F.lit(float(n_bootstrap))).alias("selection_frequency"))


def votes(stats: DataFrame, by: list[str], top: int, weight: str | None = None) -> DataFrame:
    """(feature, n_specs_selected): groups in which a feature is among the top by mean absolute importance."""
    n = F.sum(weight) if weight else F.count("*")
    return top_k(stats, by, "mean_abs_coefficient", top).groupBy("feature").agg(n.cast("bigint").alias("n_specs_selected"))


def mean_abs(attributions: DataFrame) -> DataFrame:
    """feature, mean_abs_shap, pct of the total."""
    m = attributions.groupBy("feature").agg(F.avg(F.abs("shap")).alias("mean_abs_shap"))
    return m.withColumn("pct", F.col("mean_abs_shap") / F.sum("mean_abs_shap").over(Window.partitionBy()) * 100)


def consensus(stable: DataFrame, shap: DataFrame, voted: DataFrame) -> DataFrame:
    """Outer join of three importances, missing as 0; mean of their normalized ranks."""
    t = stable.select("feature", F.col("selection_frequency").alias("stability_selection_freq"))
    t = t.join(shap.select("feature", F.col("mean_abs_shap").alias("shap_mean_abs")), "feature", "full")
    t = t.join(voted.select("feature", F.col("n_specs_selected").cast("double").alias("spec_curve_votes")), "feature", "full")
    names = {"stability_selection_freq": "rank_stability", "shap_mean_abs": "rank_shap", "spec_curve_votes": "rank_spec_votes"}
    t = t.select("feature", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in names])
    t = t.withColumns({r: normalized_rank(c) for c, r in names.items()})
    return t.withColumn("consensus_score", (F.col("rank_stability") + F.col("rank_shap") + F.col("rank_spec_votes")) / 3).withColumn(
        "n_criteria_present", sum((present(F.col(c)) for c in names), F.lit(0))
    )


def majority_params(params: DataFrame, by: list[str]) -> DataFrame:
    """The combination chosen most often, the first seen among equals."""
    counted = params.groupBy(*by, "params").agg(F.count("*").alias("n_folds"), F.min("fold").alias("first_fold"))
    order = Window.partitionBy(*by).orderBy(F.desc("n_folds"), "first_fold")
    return counted.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")
