"""Specification curve: a grid of preparation choices by models, and batch diagnostics."""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import is_shape
from ..sources.sinks import cut_lineage
from . import consensus, resample, solvers
from .metrics import fold_metrics, roc_auc
from .models import Cohort, auc_of
from .reduction import correlations, cut_clusters, representatives, select_genes, variance_filter, zscores

# The grid.
GRID = {
    "data_source": ("imaging", "genes", "both"),
    "gene_selection_method": ("variance", "iqr_top_pct", "iqr_top_n"),
    "exclude_shape": (True, False),
    "redundancy_corr_threshold": (0.80, 0.90, 0.95),
}
LINEAR_C, LINEAR_L1 = (0.01, 0.05, 0.1, 0.5, 1.0, 5.0), (0.1, 0.3, 0.5, 0.7, 0.9)
SPEC_SCHEMA = "data_source string, gene_selection_method string, exclude_shape boolean, redundancy_corr_threshold double"


def spec_grid(spark: SparkSession, grid: dict | None = None) -> DataFrame:
    grid = grid or GRID
    return spark.createDataFrame(list(itertools.product(*grid.values())), SPEC_SCHEMA)


def distinct_specs(specs: DataFrame) -> DataFrame:
    """Specifications that differ in what they compute, with how many of the grid each stands for:
    genes don't have a shape option, imaging has no gene method."""
    gene = F.when(F.col("data_source") != "imaging", F.col("gene_selection_method"))
    shape = F.when(F.col("data_source") != "genes", F.col("exclude_shape"))
    return specs.groupBy("data_source", gene.alias("gene_selection_method"), shape.alias("exclude_shape"), "redundancy_corr_threshold").agg(
        F.count("*").alias("multiplicity")
    )


#: Reduction groups of a data source: imaging texture and shape apart or together, genes by their selection.
def _groups_of(specs: DataFrame) -> DataFrame:
    """``specs`` with reduction_group, once for each group that the specification takes features from."""
    gene = F.concat(F.lit("genes:"), "gene_selection_method")
    rad = F.when(F.col("exclude_shape"), F.array(F.lit("texture"), F.lit("shape"))).otherwise(F.array(F.lit("radiomics")))
    taken = F.when(F.col("data_source") == "imaging", rad).when(F.col("data_source") == "genes", F.array(gene)).otherwise(F.concat(rad, F.array(gene)))
    return specs.withColumn("reduction_group", F.explode(taken))


def _members(long: DataFrame, methods: Sequence[str]) -> DataFrame:
    """(reduction_group, block, feature) of every group that any specification may need."""
    imaging, gene = long.where("block = 'rad'"), long.where("block = 'gen'")
    kept = variance_filter(imaging).select("feature")
    parts = F.array(F.lit("radiomics"), F.when(is_shape(F.col("feature")), "shape").otherwise("texture"))
    out = kept.select(F.explode(parts).alias("reduction_group"), F.lit("rad").alias("block"), "feature")
    for m in methods:
        out = out.unionByName(select_genes(gene, m).select(F.lit(f"genes:{m}").alias("reduction_group"), F.lit("gen").alias("block"), "feature"))
    return out


def spec_features(long: DataFrame, specs: DataFrame) -> DataFrame:
    """(spec columns, multiplicity, names: sorted features) of each distinct specification, in one plan.

    There is one table of correlations and one linkage tree for each reduction group, which all
    thresholds cut; specifications pick their groups' representatives at their threshold."""
    known = distinct_specs(specs)
    grid = known.select("gene_selection_method", "redundancy_corr_threshold").distinct().collect()  # the grid's options
    methods = sorted({r[0] for r in grid if r[0]})
    thresholds = sorted({r[1] for r in grid})
    members = cut_lineage(_members(long, methods))
    rho = correlations(long.join(members.select("block", "feature").distinct(), ["block", "feature"], "left_semi"), by=("block",))
    one = members.select("block", "reduction_group", F.col("feature").alias("i"))
    two = members.select("block", "reduction_group", F.col("feature").alias("j"))
    rho = cut_lineage(rho.join(one, ["block", "i"]).join(two, ["block", "reduction_group", "j"]).select("reduction_group", "i", "j", "rho"))
    cut = cut_clusters(rho, members, thresholds)
    kept = representatives(long, cut, ["reduction_group", "threshold", "cluster"]).select("reduction_group", "threshold", "feature")
    keys = [c.split()[0] for c in SPEC_SCHEMA.split(", ")]
    wanted = _groups_of(known).withColumn("threshold", F.col("redundancy_corr_threshold"))
    return wanted.join(kept, ["reduction_group", "threshold"]).groupBy(*keys, "multiplicity").agg(F.array_sort(F.collect_set("feature")).alias("names"))


def inner_places(y: np.ndarray, seed: int, k: int = 3) -> np.ndarray:
    """Fold of each row, by class."""
    place = np.empty(len(y), int)
    for c in (0, 1):
        own = np.random.default_rng(seed).permutation(np.flatnonzero(y == c))
        place[own] = np.arange(len(own)) % k
    return place


def chosen_penalties(sets: DataFrame, held, n_folds: int, seed: int, cs: Sequence[float] = LINEAR_C, ratios: Sequence[float] = LINEAR_L1, n_inner: int = 3) -> DataFrame:
    """(set, fold, names, c, l1_ratio): of each feature set (set, names) and outer fold, the penalty of
    the best mean inner AUC, the first of C, then of l1 ratio, among equals.

    A row fits one path: a set, an outer fold, an inner fold and an l1 ratio, along all C."""
    paths = sets.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))))
    paths = paths.withColumn("inner", F.explode(F.sequence(F.lit(0), F.lit(n_inner - 1)))).withColumn("l1_ratio", F.explode(F.array(*[F.lit(float(r)) for r in ratios])))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cohort, outer = held.value
        at = {f: i for i, f in enumerate(cohort.features)}
        for batch in batches:
            out = []
            for k, names, fold, inner, ratio in batch[["set", "names", "fold", "inner", "l1_ratio"]].itertuples(index=False):
                own = outer != fold
                x, y = cohort.x[np.ix_(own, [at[f] for f in names])], cohort.y[own]
                place = inner_places(y, seed, n_inner)
                train, test = place != inner, place == inner
                if len(set(y[train])) == 2 and len(set(y[test])) == 2:
                    made = solvers.elastic_net_path(x[train], y[train], cs, ratio)
                    out += [(k, fold, ratio, c, auc_of(y[test], fit.proba(x[test]))) for c, fit in zip(cs, made)]
            yield pd.DataFrame(out, columns=["set", "fold", "l1_ratio", "c", "auc"])

    scored = dealt(paths).mapInPandas(run, "set int, fold int, l1_ratio double, c double, auc double")
    mean = scored.groupBy("set", "fold", "c", "l1_ratio").agg(F.avg("auc").alias("auc"))
    best = mean.groupBy("set", "fold").agg(F.max_by(F.struct("c", "l1_ratio"), F.struct("auc", -F.col("c"), -F.col("l1_ratio"))).alias("p"))
    first = F.struct(F.lit(float(cs[0])).alias("c"), F.lit(float(ratios[0])).alias("l1_ratio"))
    every = sets.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1)))).join(best, ["set", "fold"], "left")
    return every.withColumn("p", F.coalesce("p", first)).select("set", "fold", "names", "p.c", "p.l1_ratio")


def dealt(rows: DataFrame) -> DataFrame:
    """Rows of much work each, dealt to some tasks a core."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)


def spec_fits(spark: SparkSession, cohort: Cohort, outer: np.ndarray, sets: DataFrame, kinds: Sequence[str], n_folds: int, seed: int, trees: int) -> DataFrame:
    """set, model_type, fold, and either id, y, value (probability) or feature, value (importance)."""
    held = spark.sparkContext.broadcast((cohort, outer))
    tasks = []
    if "linear" in kinds:
        tasks.append(chosen_penalties(sets, held, n_folds, seed).withColumn("model_type", F.lit("linear")))
    if "tree" in kinds:
        every = sets.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))))
        tasks.append(every.withColumns({"model_type": F.lit("tree"), "c": F.lit(None).cast("double"), "l1_ratio": F.lit(None).cast("double")}))
    todo = tasks[0] if len(tasks) == 1 else tasks[0].unionByName(tasks[1])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cohort, outer = held.value
        at = {f: i for i, f in enumerate(cohort.features)}
        for batch in batches:
            for k, kind, fold, names, c, ratio in batch[["set", "model_type", "fold", "names", "c", "l1_ratio"]].itertuples(index=False):
                names = list(names)
                x = cohort.x[:, [at[f] for f in names]]
                train, test = outer != fold, np.flatnonzero(outer == fold)
                fit = solvers.elastic_net(x[train], cohort.y[train], c, ratio) if kind == "linear" else solvers.random_forest(x[train], cohort.y[train], trees, 3, 5, seed)
                head = {"set": k, "model_type": kind, "fold": fold}
                yield pd.DataFrame(head | {"id": [cohort.ids[i] for i in test], "feature": None, "y": cohort.y[test], "value": fit.proba(x[test])})
                yield pd.DataFrame(head | {"id": None, "feature": names, "y": 0, "value": fit.importance()})

    return dealt(todo).mapInPandas(run, "set int, model_type string, fold int, id string, feature string, y int, value double")


def spec_curve(spark: SparkSession, long: DataFrame, labels: DataFrame, specs: DataFrame, kinds: Sequence[str] = ("linear", "tree"), n_folds: int = 5, top: int = 15, seed: int = 42, trees: int = 200) -> dict[str, DataFrame]:
    """curve, votes, votes_by_model and stats; votes count a specification as often as the grid has it.

    Specification and fold are keys of one plan from reduction to metrics. Specifications that keep
    the same features are one set, which is fitted once and stands for all of them."""
    long = cut_lineage(long)
    cohort = Cohort.of(long, labels)
    folds = resample.stratified_folds(cohort.labels(spark), n_folds, seed)
    fold_of = {r["id"]: r["fold"] for r in folds.toLocalIterator()}
    outer = np.array([fold_of[i] for i in cohort.ids])
    described = spec_features(long, specs)
    number = (F.dense_rank().over(Window.orderBy("names")) - 1).cast("int")  # the grid: some tens of rows
    spec = (F.row_number().over(Window.orderBy(*[c.split()[0] for c in SPEC_SCHEMA.split(", ")])) - 1).cast("int")
    described = cut_lineage(described.withColumns({"set": number, "spec": spec, "n_features": F.size("names")}))
    fitted = cut_lineage(spec_fits(spark, cohort, outer, described.select("set", "names").distinct(), kinds, n_folds, seed, trees))
    own = ["set", "model_type"]
    scored = fitted.where("id is not null").withColumnRenamed("value", "p").withColumn("pred", (F.col("p") > 0.5).cast("int"))
    per_fold = fold_metrics(scored, [*own, "fold"]).groupBy(*own).agg(F.avg("auc").alias("auc_mean_fold"), F.stddev_pop("auc").alias("auc_sd_fold"))
    pooled = roc_auc(scored, own).select(*own, F.col("auc").alias("auc_pooled"))
    stats = consensus.feature_stats(fitted.where("feature is not null").withColumnRenamed("value", "importance"), own)
    for c in ("fraction_positive", "fraction_negative"):
        stats = stats.withColumn(c, F.when(F.col("model_type") == "linear", F.col(c)))
    stats = cut_lineage(stats)
    curve = cut_lineage(per_fold.join(pooled, own).join(consensus.collapsed(stats, own), own)).join(described.drop("names"), "set").drop("set")
    keys = ["spec", "model_type"]
    weighted = stats.join(described.select("set", "spec", "multiplicity"), "set").drop("set")
    return {
        "curve": curve.withColumn("position", F.row_number().over(Window.orderBy("auc_pooled", *keys))),
        "votes": consensus.votes(weighted, keys, top, "multiplicity"),
        "votes_by_model": _votes_by_model(weighted, keys, top),
        "stats": stats.join(described.drop("names"), "set").drop("set"),
    }


def _votes_by_model(stats: DataFrame, keys: list[str], top: int) -> DataFrame:
    from ..functions.ranking import top_k

    return top_k(stats, keys, "mean_abs_coefficient", top).groupBy("model_type", "feature").agg(F.sum("multiplicity").alias("n_specs_selected"))


#: Features of a principal component analysis: their products, a square of them, come to the driver.
MOST_FEATURES = 3000


def components_of(rho: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Loadings (features x k, the largest of each positive) and shares of variance, of a correlation matrix."""
    value, vector = np.linalg.eigh(rho)
    value, vector = np.maximum(value[::-1][:k], 0), vector[:, ::-1][:, :k]
    vector = vector * np.sign(vector[np.abs(vector).argmax(axis=0), np.arange(vector.shape[1])])
    return vector, value / max(np.trace(rho), 1e-300)


def pca(long: DataFrame, k: int = 2) -> DataFrame:
    """(id, pc1..pck, explained1..k) of standardized features (id, feature, value), without gaps.

    The correlations are sums of products by tiles; only they, features squared, come to the driver
    for their eigenvectors. Scores are a sum of cells times loadings: no matrix of rows is made."""
    long = cut_lineage(long.select("id", "feature", "value"))
    sd = variance_filter(long).select("feature")
    kept = long.join(sd, "feature", "left_semi")
    pairs = correlations(kept, "pearson")
    names = sorted(r["feature"] for r in sd.collect())
    if len(names) > MOST_FEATURES:
        raise ValueError(f"{len(names)} features are over {MOST_FEATURES}; reduce them first")
    at = {f: i for i, f in enumerate(names)}
    rho = np.eye(len(names))
    got = pairs.toArrow()
    i, j = (np.array([at[f] for f in got[c].to_pylist()], int) for c in ("i", "j"))
    rho[i, j] = rho[j, i] = got["rho"].to_numpy()
    k = min(k, len(names))
    vector, share = components_of(rho, k)
    spark = long.sparkSession
    loads = spark.createDataFrame([(f, *map(float, v)) for f, v in zip(names, vector)], ", ".join(["feature string", *[f"l{c} double" for c in range(k)]]))
    z = zscores(kept).join(F.broadcast(loads), "feature")  # a row a feature, checked above
    sums = z.groupBy("id").agg(*[F.sum(F.col("z") * F.col(f"l{c}")).alias(f"pc{c + 1}") for c in range(k)])
    return sums.withColumns({f"explained{c + 1}": F.lit(float(share[c])) for c in range(k)})


def pca_scores(spark: SparkSession, cohort: Cohort, k: int = 2) -> DataFrame:
    """(id, pc1..pck, explained1..k) of a cohort's standardized features."""
    cells = [(i, f, float(v)) for i, row in zip(cohort.ids, cohort.x) for f, v in zip(cohort.features, row)]
    return pca(spark.createDataFrame(cells, "id string, feature string, value double"), k)
