"""A study from aligned long features and labels to its result tables, and the command line."""

from __future__ import annotations

import argparse
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import binarize
from ..operators import align, consensus, hypothesis_tests, metrics, models, multiverse, reduction
from ..sources import sheets, sinks


@dataclass(frozen=True)
class Config:
    """Thresholds, fold counts and seeds."""

    positive: str = "ADK"
    n_outer: int = 5
    n_inner: int = 5
    seed: int = 42
    redundancy_threshold: float = 0.9
    gene_method: str = "iqr_top_pct"
    exclude_shape: bool = True
    n_bootstrap: int = 200
    stability_threshold: float = 0.6
    n_permutations: int = 200
    permutation_folds: int = 5
    models: tuple[str, ...] = tuple(models.MODELS)
    grids: dict | None = field(default=None)


class Study:
    """``long``: id, block, feature, value; ``labels``: id, label; ``batches``: id, batch."""

    def __init__(self, spark: SparkSession, long: DataFrame, labels: DataFrame, config: Config = Config(), batches: DataFrame | None = None):
        self.spark, self.config, self.batches = spark, config, batches
        align.require_unique(labels, ["id"])
        align.require_unique(long, ["id", "feature"])
        blocks = long.select("block").distinct().count()
        self.long = align.with_labels(align.align_blocks(long, blocks), labels).select("id", "block", "feature", "value")
        self.labels = labels.where("label is not null").select("id", binarize(F.col("label"), config.positive).alias("y"))
        self._cohort: models.Cohort | None = None

    def reduced(self) -> DataFrame:
        c = self.config
        kept = reduction.neutral_reduction(self.long, c.gene_method, c.exclude_shape, c.redundancy_threshold)
        return self.long.join(kept.select("feature"), "feature", "left_semi")

    def cohort(self) -> models.Cohort:
        if self._cohort is None:
            self._cohort = models.Cohort.of(self.reduced(), self.labels)
        return self._cohort

    def run(self, root: str, run: str) -> dict:
        """Reduction, nested cross-validation, pooled metrics, stability, attributions. The best
        model is chosen by pooled out-of-fold AUC and then reported on it: an optimistic figure."""
        c, spark = self.config, self.spark
        manifest = sinks.Manifest(spark, root, run)
        write = manifest.write
        write(self.long, "features")
        write(self.reduced(), "reduced")
        cohort = self.cohort()
        result = models.nested_cv(spark, cohort, c.models, c.n_outer, c.n_inner, c.seed, c.grids)
        metrics.require_sound(result.predictions, cohort.labels(spark), ["model"])
        write(result.predictions, "predictions", "model")
        write(result.best, "params")
        write(metrics.fold_summary(result.metrics, ["model"]), "comparison")
        pooled = metrics.pooled(result.predictions, ["model"]).join(metrics.fold_summary(result.metrics, ["model"], "_fold"), "model")
        write(pooled, "pooled")
        best = pooled.orderBy(F.desc("pooled_oof_auc"), "model").first()["model"]
        params = self.majority(result.best, best)
        top = max(5, int(len(cohort.features) ** 0.5))
        stable = consensus.stability(models.bootstrap_importances(spark, cohort, best, params, c.n_bootstrap, c.seed), ["b"], top, c.n_bootstrap)
        write(stable, "stability")
        write(stable.where(F.col("selection_frequency") >= c.stability_threshold), "stable")
        shap = result.attributions.where(F.col("model") == best)
        write(shap, "shap")
        write(consensus.mean_abs(shap), "shap_importance")
        size = lambda df: df.select("feature").distinct().count()
        path = sinks.write_config(spark, c, root, run, n_ids=self.long.select("id").distinct().count(), n_features=size(self.long), n_reduced=len(cohort.features), best_model=best)
        manifest.commit("config", path)
        manifest.close()
        return {"best_model": best, "params": params}

    @staticmethod
    def majority(best: DataFrame, model: str) -> dict:
        row = consensus.majority_params(best.where(F.col("model") == model), ["model"]).first()
        return models._clean(row["params"])

    def diagnose(self, root: str, run: str) -> dict[str, DataFrame]:
        """Permutation test of the best model with its fixed parameters, and the batch check."""
        c, spark = self.config, self.spark
        best = spark.read.parquet(sinks.whole_table(spark, root, run, "pooled")).orderBy(F.desc("pooled_oof_auc"), "model").first()["model"]
        params = self.majority(spark.read.parquet(sinks.whole_table(spark, root, run, "params")), best)
        perms = models.permutation_test(spark, self.cohort(), best, params, c.n_permutations, c.permutation_folds, c.seed)
        sinks.write_table(perms, root, run, "permutations")
        perms = spark.read.parquet(f"{root}/{run}/permutations")
        summary = hypothesis_tests.verdicts(hypothesis_tests.permutation_summary(perms))
        sinks.write_table(summary, root, run, "permutation_summary")
        out = {"permutation": summary, "permutation_histogram": metrics.histogram(perms, "auc", 20)}
        scores = multiverse.pca(self.reduced())
        out["pca"] = scores.join(self.labels, "id", "left")
        if self.batches is not None:
            out["pca"] = align.with_batch(out["pca"], self.batches)
            test = hypothesis_tests.kruskal_wallis(out["pca"], "pc1", "batch", [])
            out["batch"] = test.select("h", "p_value", F.coalesce(F.col("p_value") < 0.05, F.lit(False)).alias("significant"))
        return out


SOURCES = {"imaging": ("rad",), "genes": ("gen",), "both": ("rad", "gen")}


def from_sheets(
    spark: SparkSession,
    metadata: str,
    key: str,
    label: str,
    imaging: str | None = None,
    genes: str | None = None,
    batch: str | None = None,
    source: str = "both",
    drop: int = 2,
    config: Config = Config(),
) -> Study:
    """A study of CSV exports: ``metadata`` and ``genes`` have entities in columns (the last ``drop``
    columns of genes aren't entities), ``imaging`` has them in rows. Only sheets of ``source`` are read."""
    cells = sheets.transposed(sheets.read_text_table(spark, metadata))
    labels = sheets.attribute(cells, key, label, "label")
    if labels is None:
        raise ValueError(f"no attribute {label!r} in {metadata}")
    batches = sheets.attribute(cells, key, batch, "batch") if batch else None
    parts = []
    if "rad" in SOURCES[source]:
        parts.append(sheets.feature_block(sheets.upright(sheets.read_text_table(spark, imaging)), "rad"))
    if "gen" in SOURCES[source]:
        parts.append(sheets.feature_block(sheets.transposed(sheets.drop_last(sheets.read_text_table(spark, genes), drop)), "gen"))
    long = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return Study(spark, long, labels, config, batches)


def compare_sources(spark: SparkSession, root: str, model: str, one: str, two: str, n_boot: int = 2000, seed: int = 42) -> DataFrame:
    """DeLong test and paired bootstrap of two sources' out-of-fold predictions of one model."""
    own = lambda run: spark.read.parquet(sinks.whole_table(spark, root, run, "predictions")).where(F.col("model") == model)
    pairs = align.pair_results(own(one), own(two)).persist()
    diffs = hypothesis_tests.paired_auc_diffs(pairs, n_boot, seed)
    diffs = spark.read.parquet(sinks.write_table(diffs, root, "comparisons", f"{model}_{one}_{two}"))
    sinks.write_table(metrics.histogram(diffs, "diff", 40), root, "comparisons", f"{model}_{one}_{two}_histogram")
    out = hypothesis_tests.compared(pairs, diffs)
    sinks.write_table(out, root, "comparisons", f"{model}_{one}_{two}_summary")
    pairs.unpersist()
    return out


def consensus_of(spark: SparkSession, root: str, run: str, votes: str, catalog: DataFrame | None = None) -> DataFrame:
    """Feature consensus of a run's stable features and attributions with votes of a specification curve."""
    path = (lambda kind: sheets.artifact_path(catalog, run, kind, "best")) if catalog is not None else (lambda kind: sinks.whole_table(spark, root, run, kind))
    out = consensus.consensus(spark.read.parquet(path("stable")), spark.read.parquet(path("shap_importance")), spark.read.parquet(votes))
    sinks.write_table(out, root, run, "consensus")
    return out


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("action", choices=["run", "diagnose", "spec-curve", "compare", "consensus"])
    parser.add_argument("--features", help="Parquet of id, block, feature, value")
    parser.add_argument("--labels", help="Parquet of id, label")
    parser.add_argument("--metadata", help="CSV export with entities in columns; with it, sheets are read instead of Parquet")
    parser.add_argument("--key", help="the attribute of the metadata that names an entity")
    parser.add_argument("--label", help="the attribute that is the outcome")
    parser.add_argument("--batch", help="the attribute that is the batch")
    parser.add_argument("--imaging", help="CSV export with entities in rows")
    parser.add_argument("--genes", help="CSV export with entities in columns")
    parser.add_argument("--models", nargs="+", choices=list(models.MODELS), default=list(models.MODELS))
    parser.add_argument("--root", required=True)
    parser.add_argument("--run", default="both")
    parser.add_argument("--positive", default=Config.positive)
    parser.add_argument("--model", default="elastic_net")
    parser.add_argument("--source-a")
    parser.add_argument("--source-b")
    parser.add_argument("--votes")
    parser.add_argument("--n-boot", type=int, default=2000)
    parser.add_argument("--source", choices=list(SOURCES), default="both", help="blocks to study")
    a = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if a.action == "compare":
        compare_sources(spark, a.root, a.model, a.source_a, a.source_b, a.n_boot).show(truncate=False)
        return
    if a.action == "consensus":
        consensus_of(spark, a.root, a.run, a.votes or f"{a.root}/spec_curve/votes").show(25, truncate=False)
        return
    config = Config(positive=a.positive, models=tuple(a.models))
    if a.metadata:
        study = from_sheets(spark, a.metadata, a.key, a.label, a.imaging, a.genes, a.batch, a.source, config=config)
    else:
        long, labels = spark.read.parquet(a.features).where(F.col("block").isin(*SOURCES[a.source])), spark.read.parquet(a.labels)
        study = Study(spark, long, labels, config)
    if a.action == "run":
        print(study.run(a.root, a.run))
    elif a.action == "diagnose":
        for df in study.diagnose(a.root, a.run).values():
            df.show(5, truncate=False)
    else:
        for kind, df in multiverse.spec_curve(spark, study.long, study.labels, multiverse.spec_grid(spark)).items():
            sinks.write_table(df, a.root, "spec_curve", kind)


if __name__ == "__main__":
    main()
