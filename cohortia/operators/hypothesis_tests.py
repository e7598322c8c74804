"""Tests: DeLong, paired bootstrap, permutation, Kruskal-Wallis."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ranking import below, quantiles, value_ranks, with_value
from ..functions.tails import chi2_tail, normal_tails
from ..sources.sinks import cut_lineage
from . import resample
from .metrics import roc_auc


def delong_components(pairs: DataFrame, by: list[str]) -> DataFrame:
    """by..., model, id, y, v: a positive's share of negatives below it, a negative's share of positives above it."""
    long = cut_lineage(pairs.unpivot([*by, "id", "y"], ["a", "b"], "model", "p"))
    keys = [*by, "model"]
    pos, neg = F.sum("y").cast("double"), F.sum(1 - F.col("y")).cast("double")
    sizes = long.groupBy(*keys).agg(pos.alias("m"), neg.alias("n"))  # a row a model and group
    scores = below(long.groupBy(*keys, "p").agg(pos.alias("pos"), neg.alias("neg"), F.count("*").alias("rows")), keys, "p", ["pos", "neg"])
    under = (F.col("neg_below") + F.col("neg") / 2) / F.col("n")
    over = 1 - (F.col("pos_below") + F.col("pos") / 2) / F.col("m")
    scores = scores.join(F.broadcast(sizes), keys).select(*keys, "p", "rows", under.alias("under"), over.alias("over"))
    v = F.when(F.col("y") == 1, F.col("under")).otherwise(F.col("over"))
    return with_value(long, scores, [*keys, "p"], "rows", long.count()).select(*keys, "id", "y", v.alias("v"))


def delong(pairs: DataFrame, by: list[str]) -> DataFrame:
    """by..., auc_a, auc_b, diff (b less a), se_diff, ci_low, ci_high, z, p_value (two-sided; 1 where both are equal throughout)."""
    v = delong_components(pairs, by)
    own = lambda m: F.max(F.when(F.col("model") == m, F.col("v")))
    per = v.groupBy(*by, "id", "y").agg(own("a").alias("va"), own("b").alias("vb"))
    s = per.groupBy(*by, "y").agg(
        F.avg("va").alias("auc_a"), F.avg("vb").alias("auc_b"), ((F.var_samp("va") + F.var_samp("vb") - 2 * F.covar_samp("va", "vb")) / F.count("*")).alias("part")
    )
    pos = lambda c: F.max(F.when(F.col("y") == 1, F.col(c)))
    out = s.groupBy(*by).agg(pos("auc_a").alias("auc_a"), pos("auc_b").alias("auc_b"), F.sum("part").alias("var"))
    out = out.withColumn("diff", F.col("auc_b") - F.col("auc_a")).withColumn("se_diff", F.sqrt(F.greatest("var", F.lit(0.0))))
    half = F.lit(1.96) * F.col("se_diff")
    z = F.when(F.col("se_diff") > 0, F.col("diff") / F.col("se_diff")).otherwise(F.lit(0.0))
    out = out.select(*by, "auc_a", "auc_b", "diff", "se_diff", (F.col("diff") - half).alias("ci_low"), (F.col("diff") + half).alias("ci_high"), z.alias("z"))
    return out.withColumn("p_value", normal_tails(F.col("z")))


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def chi2_upper(spark: SparkSession, x: float, df: int) -> float:
    """Upper tail of one number."""
    return spark.range(1).select(chi2_tail(F.lit(float(x)), F.lit(float(df)))).first()[0]


def delong_p(row) -> float:
    return normal_two_sided(row["z"]) if row["se_diff"] > 0 else 1.0


def bootstrap_summary(diffs: DataFrame, observed: str = "observed", diff: str = "diff") -> DataFrame:
    """ci_low, ci_high, p_value, n of paired differences; the p-value doubles the share beyond zero."""
    q = quantiles(diffs, [], diff, [0.025, 0.975])
    below, above = F.avg((F.col(diff) <= 0).cast("double")), F.avg((F.col(diff) >= 0).cast("double"))
    p = F.least(F.lit(1.0), 2 * F.when(F.max(observed) >= 0, below).otherwise(above))
    rest = diffs.agg(p.alias("p_value"), F.count("*").alias("n"), F.max(observed).alias("observed"))
    return rest.join(F.broadcast(q)).select(  # one row each
        "observed", F.col("q")[0].alias("ci_low"), F.col("q")[1].alias("ci_high"), "p_value", "n"
    )


def auc_diff(pairs: DataFrame) -> DataFrame:
    """observed: AUC of b less that of a, of rows (id, y, a, b)."""
    auc = roc_auc(pairs.unpivot(["id", "y"], ["a", "b"], "m", "p"), ["m"])
    own = lambda m: F.max(F.when(F.col("m") == m, F.col("auc")))
    return auc.agg((own("b") - own("a")).alias("observed"))


def paired_auc_diffs(pairs: DataFrame, n_boot: int, seed: int) -> DataFrame:
    """(b, diff) of ``n_boot`` resamples of rows (id, y, a, b), AUC of b less that of a.

    A resample without both classes is drawn again, with the attempt in its hash, until it has
    both. A resample is drawn, counted and judged in one task; one number of each, at most
    ``n_boot``, comes to the driver, which asks for the missing ones again."""
    spark = pairs.sparkSession
    rows = cut_lineage(resample.positions(pairs.select("id", "y", F.col("a").alias("p_a"), F.col("b").alias("p_b"))))
    classes = [r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()]  # two numbers
    if len(classes) < 2:
        raise ValueError("a bootstrap of one class never holds both")
    n = sum(classes)
    wanted, found, attempt = list(range(n_boot)), [], 0
    while wanted:
        drawn = resample.draws(spark, rows, n, wanted, seed, attempt)
        long = drawn.unpivot(["b", "y", "times"], ["p_a", "p_b"], "m", "p")
        sums = long.groupBy("b", "m", "p").agg(F.sum(F.col("times") * F.col("y")).alias("pos"), F.sum(F.col("times") * (1 - F.col("y"))).alias("neg"))
        under = Window.partitionBy("b", "m").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
        wins = sums.withColumn("w", F.col("pos") * (F.coalesce(F.sum("neg").over(under), F.lit(0)) + F.col("neg") / 2))
        auc = F.sum("w") / F.nullif((F.sum("pos") * F.sum("neg")).cast("double"), F.lit(0.0))
        aucs = wins.groupBy("b", "m").agg(auc.alias("auc"))
        own = lambda m: F.max(F.when(F.col("m") == m, F.col("auc")))
        got = aucs.groupBy("b").agg((own("p_b") - own("p_a")).alias("diff")).where("diff is not null").collect()
        found += [(r["b"], r["diff"]) for r in got]
        wanted = sorted(set(wanted) - {r["b"] for r in got})
        attempt += 1
    return spark.createDataFrame(sorted(found), "b int, diff double")


def compared(pairs: DataFrame, diffs: DataFrame) -> DataFrame:
    """DeLong's test of rows (id, y, a, b), the interval and p-value of their resampled ``diffs``, and
    the verdicts of both."""
    boot = bootstrap_summary(diffs.join(F.broadcast(auc_diff(pairs))))  # one row
    boot = boot.select(F.col("ci_low").alias("boot_ci_low"), F.col("ci_high").alias("boot_ci_high"), F.col("p_value").alias("boot_p_value"))
    out = delong(pairs, []).join(F.broadcast(boot))  # one row
    return out.withColumns({"differs_by_test": F.col("p_value") < 0.05, "differs_by_interval": (F.col("boot_ci_low") > 0) | (F.col("boot_ci_high") < 0)})


def permutation_summary(permuted: DataFrame, real: str = "auc_real", auc: str = "auc") -> DataFrame:
    """auc_real, p_value = (exceeding + 1) / (n + 1), perm_mean, perm_sd."""
    over = F.sum((F.col(auc) >= F.col(real)).cast("bigint"))
    return permuted.agg(
        F.max(real).alias("auc_real"),
        ((over + 1) / (F.count("*") + 1)).alias("p_value"),
        F.avg(auc).alias("perm_mean"),
        F.stddev_pop(auc).alias("perm_sd"),
    )


def kruskal_wallis(df: DataFrame, value: str, group: str, by: list[str]) -> DataFrame:
    """by..., h (corrected for ties), df, n, p_value; rows without value or group don't count.

    Ranks are of distinct values, joined with counts of (value, group): no task sees all rows."""
    rows = df.where(F.col(value).isNotNull() & F.col(group).isNotNull())
    ranks = value_ranks(rows, by, value, "r")
    t = F.col("n").cast("double")
    ties = ranks.groupBy(*by).agg(F.sum(t**3 - t).alias("ties"))
    counts = rows.groupBy(*by, value, group).agg(F.count("*").alias("m"))
    parts = counts.join(ranks, [*by, value]).groupBy(*by, group).agg(F.sum(F.col("m") * F.col("r")).alias("s"), F.sum("m").alias("m"))
    total = parts.groupBy(*by).agg(F.sum(F.col("s") ** 2 / F.col("m")).alias("s"), F.sum("m").alias("n"), (F.count("*") - 1).alias("df"))
    joined = total.join(ties, by) if by else total.crossJoin(F.broadcast(ties))  # one row each
    n = F.col("n").cast("double")
    h = (12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1)) / F.nullif(1 - F.col("ties") / (n**3 - n), F.lit(0.0))
    return joined.select(*by, h.alias("h"), "df", "n").withColumn("p_value", F.when(F.col("df") > 0, chi2_tail(F.col("h"), F.col("df"))))


def verdicts(df: DataFrame, p: str = "p_value") -> DataFrame:
    return df.withColumn("significant", F.col(p) < 0.05)
