"""Metrics of scores and predictions, for all groups in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import below


def roc_auc(scored: DataFrame, by: list[str], score: str = "p", label: str = "y", weight: str | None = None) -> DataFrame:
    """by..., auc, n_pos, n_neg; ties count half; null where a class is missing.

    Rows are first summed by distinct score, and scores are passed in ranges, so that no task sees
    all scores of a group; a weight counts a row several times (a bootstrap's multiplicity)."""
    w = F.col(weight) if weight else F.lit(1)
    sums = scored.groupBy(*by, score).agg(F.sum(w * F.col(label)).cast("double").alias("_p"), F.sum(w * (1 - F.col(label))).cast("double").alias("_n"))
    wins = F.col("_p") * (F.col("_n_below") + F.col("_n") / 2)
    out = below(sums, by, score, ["_n"]).withColumn("_w", wins)
    out = out.groupBy(*by).agg(F.sum("_w").alias("_w"), F.sum("_p").cast("bigint").alias("n_pos"), F.sum("_n").cast("bigint").alias("n_neg"))
    auc = F.col("_w") / F.nullif((F.col("n_pos") * F.col("n_neg")).cast("double"), F.lit(0.0))
    return out.withColumn("auc", auc).drop("_w").select(*by, "auc", "n_pos", "n_neg")


def confusion(scored: DataFrame, by: list[str], label: str = "y", predicted: str = "pred") -> DataFrame:
    y, q = F.col(label), F.col(predicted)
    count = lambda c: F.sum(c.cast("bigint"))
    return scored.groupBy(*by).agg(
        count((y == 1) & (q == 1)).alias("tp"),
        count((y == 0) & (q == 1)).alias("fp"),
        count((y == 1) & (q == 0)).alias("fn"),
        count((y == 0) & (q == 0)).alias("tn"),
    )


def _share(part: Column, whole: Column) -> Column:
    return part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))


def balanced_accuracy() -> Column:
    return (_share(F.col("tp"), F.col("tp") + F.col("fn")) + _share(F.col("tn"), F.col("tn") + F.col("fp"))) / 2


def f1() -> Column:
    return F.coalesce(_share(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))


def fold_metrics(predictions: DataFrame, by: list[str]) -> DataFrame:
    """by..., auc, balanced_accuracy, f1."""
    c = confusion(predictions, by).select(*by, balanced_accuracy().alias("balanced_accuracy"), f1().alias("f1"))
    return roc_auc(predictions, by).drop("n_pos", "n_neg").join(c, by)


def fold_summary(folds: DataFrame, by: list[str], suffix: str = "") -> DataFrame:
    """Mean and population standard deviation over folds."""
    out = []
    for m in ("auc", "balanced_accuracy", "f1"):
        out += [F.avg(m).alias(f"{m}_mean{suffix}"), F.stddev_pop(m).alias(f"{m}_sd{suffix}")]
    return folds.groupBy(*by).agg(*out)


def pooled(predictions: DataFrame, by: list[str]) -> DataFrame:
    """Metrics over all out-of-fold predictions together."""
    m = fold_metrics(predictions, by)
    return m.select(*by, *[F.col(c).alias(f"pooled_oof_{c}") for c in ("auc", "balanced_accuracy", "f1")])


def oof_integrity(predictions: DataFrame, ids: DataFrame, by: list[str]) -> DataFrame:
    """by..., n_ids, n_twice, n_never, n_bad_class."""
    per = predictions.groupBy(*by, "id").agg(F.count("*").alias("n"), F.max((~F.col("pred").isin(0, 1)).cast("int")).alias("bad"))
    total = ids.select("id").distinct().count()
    return per.groupBy(*by).agg(
        F.count("*").alias("n_ids"),
        F.sum((F.col("n") > 1).cast("bigint")).alias("n_twice"),
        (F.lit(total) - F.count("*")).cast("bigint").alias("n_never"),
        F.sum(F.col("bad").cast("bigint")).alias("n_bad_class"),
    )


def require_sound(predictions: DataFrame, ids: DataFrame, by: list[str]) -> DataFrame:
    bad = oof_integrity(predictions, ids, by).where("n_twice + n_never + n_bad_class > 0").take(1)
    if bad:
        raise ValueError(f"out-of-fold predictions don't cover each row once: {bad[0].asDict()}")
    return predictions


def histogram(df: DataFrame, value: str, bins: int, by: list[str] | None = None) -> DataFrame:
    """by..., bin, n over equal widths; the largest value is in the last bin."""
    by = by or []
    edges = df.groupBy(*by).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    rows = df.join(edges, by) if by else df.crossJoin(F.broadcast(edges))  # one row
    width = (F.col("hi") - F.col("lo")) / bins
    number = F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(F.least(F.floor((F.col(value) - F.col("lo")) / width), F.lit(bins - 1)))
    return rows.groupBy(*by, number.cast("int").alias("bin")).agg(F.count("*").alias("n"))
