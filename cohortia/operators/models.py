"""Model registry, nested cross-validation, stability, permutation and specification runs.

The unit of work is one small fit. Fits are rows of a task table that Spark spreads over the
cluster; each task reads the cohort's matrix from a broadcast. Scores, folds and metrics stay
DataFrames.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import resample, solvers
from .align import wide
from .metrics import fold_metrics, roc_auc

#: Trees of a forest that one task grows.
DEAL = 100
#: Cells of a cohort whose linear fits are too short for a task each, and rows whose attributions are sent at once.
SMALL, SENT = 1 << 20, 4096
#: Labellings of a permutation test that share a pass over the rows.
LABELLINGS = 8


@dataclass(frozen=True)
class ModelSpec:
    name: str
    kind: str  # linear or tree
    fit: Callable
    grid: tuple[tuple[str, tuple], ...]
    shared: tuple[str, ...] = ()  # parameters whose values one run of ``fit_all`` serves
    fit_all: Callable | None = None  # fits of combinations that differ in ``shared`` only
    votes: Callable | None = None  # what some trees of all combinations' models add to their scores
    fit_folds: Callable | None = None  # scores of all folds of several labellings at once

    def combinations(self) -> list[dict]:
        names = [k for k, _ in self.grid]
        return [dict(zip(names, v)) for v in itertools.product(*(v for _, v in self.grid))]

    def runs(self, combos: Sequence[dict]) -> list[list[int]]:
        """Places in ``combos`` of those that one run serves."""
        found: dict[tuple, list[int]] = {}
        for k, c in enumerate(combos):
            found.setdefault((k,) if not self.shared else tuple((n, v) for n, v in sorted(c.items()) if n not in self.shared), []).append(k)
        return list(found.values())

    def fits(self, x: np.ndarray, y: np.ndarray, combos: Sequence[dict], seed: int) -> list:
        return self.fit_all(x, y, combos, seed) if self.fit_all else [self.fit(x, y, c, seed) for c in combos]

    def out_of_fold(self, x: np.ndarray, y: np.ndarray, fold: np.ndarray, k: int, params: dict, seed: int) -> np.ndarray:
        """Probabilities of the rows by models of the other folds, for several labellings (y and fold: labellings x
        rows); nan where those hold one class."""
        if self.fit_folds:
            return self.fit_folds(x, y, fold, k, params)
        out = np.full(y.shape, np.nan)
        for own, at, to in zip(y.astype(int), fold, out):
            for f in range(k):
                train, test = at != f, at == f
                if len(set(own[train])) == 2 and len(set(own[test])) == 2:
                    to[test] = self.fit(x[train], own[train], params, seed).proba(x[test])
        return out

    def parts(self, trees: int | None) -> list[range | None]:
        """Trees that one task grows, where a model is a sum of trees that don't depend on each other."""
        return [None] if self.votes is None else [range(a, min(int(trees), a + DEAL)) for a in range(0, int(trees), DEAL)]


def _elastic_net(x, y, p, seed):
    return solvers.elastic_net(x, y, p["C"], p["l1_ratio"])


def _elastic_net_folds(x, y, fold, k, p):
    return solvers.elastic_net_folds(x, y, fold, k, p["C"], p["l1_ratio"])


def _svm(x, y, p, seed):
    return solvers.linear_svm(x, y, p["C"])


def _forest(x, y, p, seed):
    return solvers.random_forest(x, y, int(p["trees"]), p["depth"] and int(p["depth"]), int(p["leaf"]), seed)


def _gbt(x, y, p, seed):
    return solvers.boosted_trees(x, y, int(p["trees"]), int(p["depth"]), p["rate"], seed)


def _path(x, y, combos, seed):
    return solvers.elastic_net_path(x, y, [c["C"] for c in combos], combos[0]["l1_ratio"])


def _staged(fit: Callable) -> Callable:
    """Models of fewer trees are the first trees of that of the most."""

    def all_of(x, y, combos, seed):
        whole = fit(x, y, combos[0] | {"trees": max(c["trees"] for c in combos)}, seed)
        return [whole.first(int(c["trees"])) for c in combos]

    return all_of


def _forests(x, y, combos, seed):
    """Shallower forests of fewer trees are the first levels of the first trees of the deepest and largest."""
    depths = [c["depth"] for c in combos]
    deepest = None if None in depths else max(depths)
    whole = _forest(x, y, combos[0] | {"trees": max(c["trees"] for c in combos), "depth": deepest}, seed)
    return [whole.first(int(c["trees"])).pruned(c["depth"] and int(c["depth"])) for c in combos]


def _part(x, y, p, numbers, seed):
    """Some trees of a forest, which add up to it but for its scale."""
    made = solvers.random_forests(x, y, numbers, p["depth"] and int(p["depth"]), (int(p["leaf"]),), seed)[int(p["leaf"])]
    return solvers.Forest(made.trees, 1.0, 0.0, False, x.shape[1])


def _votes(x, y, combos, numbers, test, seed):
    """Sums of these trees' values of the test rows for each combination; trees of all leaves grow together,
    to the largest depth."""
    depths = [c["depth"] for c in combos]
    deepest = None if None in depths else max(depths)
    grown = solvers.random_forests(x, y, numbers, deepest, [int(c["leaf"]) for c in combos], seed)
    out: list = [np.zeros(len(test))] * len(combos)
    for leaf, depth in {(int(c["leaf"]), c["depth"]) for c in combos}:
        own = [k for k, c in enumerate(combos) if (int(c["leaf"]), c["depth"]) == (leaf, depth)]
        total = np.zeros(len(test))
        for t, value in zip(numbers, grown[leaf].pruned(depth and int(depth)).values(test)):
            total = total + value
            for k in own:
                if t < combos[k]["trees"]:
                    out[k] = total
    return out


# Hyper-parameter grids.
MODELS = {
    m.name: m
    for m in (
        ModelSpec("elastic_net", "linear", _elastic_net, (("C", (0.001, 0.01, 0.05, 0.1, 0.5, 1.0)), ("l1_ratio", (0.05, 0.1, 0.3, 0.5, 0.7, 0.9))), ("C",), _path, fit_folds=_elastic_net_folds),
        ModelSpec("random_forest", "tree", _forest, (("trees", (200, 500)), ("depth", (3, 5, None)), ("leaf", (1, 3, 5))), ("trees", "depth"), _forests, _votes),
        ModelSpec("svm_linear", "linear", _svm, (("C", (0.001, 0.01, 0.1, 1.0, 10.0)),)),
        ModelSpec("gbt", "tree", _gbt, (("trees", (100, 300)), ("depth", (2, 3, 4)), ("rate", (0.01, 0.05, 0.1))), ("trees",), _staged(_gbt)),
    )
}

PARAMS = "struct<C:double,l1_ratio:double,trees:int,depth:int,leaf:int,rate:double>"


def model(name: str) -> ModelSpec:
    if name not in MODELS:
        raise ValueError(f"unknown model {name!r}; known: {sorted(MODELS)}")
    return MODELS[name]


@dataclass
class Cohort:
    """A cohort on the driver: ids in order, features in order, labels. A number takes 4 bytes where all of the
    numbers are as exact in 4, else 8; solvers reckon in 8 all the same."""

    ids: list[str]
    features: list[str]
    x: np.ndarray
    y: np.ndarray

    @classmethod
    def of(cls, long: DataFrame, labels: DataFrame) -> Cohort:
        rows, names = wide(long)
        joined = rows.join(labels.where("y is not null"), "id").select("id", "x", "y").persist()
        try:
            short = F.min(F.forall("x", lambda v: v.cast("float").cast("double").eqNullSafe(v)))
            n, exact = joined.agg(F.count("*"), short).first()
            x = np.empty((n, len(names)), np.float32 if exact else np.float64)
            got = joined.select("id", F.col("x").cast("array<float>" if exact else "array<double>").alias("x"), "y").orderBy("id").toArrow()
        finally:
            joined.unpersist()
        start = 0
        for part in got["x"].chunks:
            x[start : start + len(part)] = part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), len(names))
            start += len(part)
        if any(np.isnan(x[a : a + 65536]).any() for a in range(0, n, 65536)):
            raise ValueError("missing values reach the models; fill or drop them first")
        return cls(got["id"].to_pylist(), names, x, np.array(got["y"].to_pylist(), int))

    def labels(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i, int(v)) for i, v in zip(self.ids, self.y)], "id string, y int")


def _params(combo: dict) -> dict:
    return {k: combo.get(k) for k in ("C", "l1_ratio", "trees", "depth", "leaf", "rate")}


def _each(spark: SparkSession, n: int, alone: bool) -> DataFrame:
    """The numbers of n tasks, each alone in its partition or a few together."""
    return spark.range(0, n, 1, max(1, n if alone else min(n, spark.sparkContext.defaultParallelism * 4)))


def _folds(cohort: Cohort, folds: DataFrame) -> np.ndarray:
    got = folds.select("id", "fold").toArrow()
    out = np.empty(len(cohort.ids), int)
    out[pd.Index(cohort.ids).get_indexer(got["id"].to_pandas())] = got["fold"].to_numpy()
    return out


def grid_search(spark: SparkSession, cohort: Cohort, names: Sequence[str], n_outer: int, n_inner: int, seed: int, grids: dict[str, list[dict]] | None = None) -> tuple[DataFrame, np.ndarray]:
    """(model, outer, combo, params, auc): mean inner AUC of every combination, and the outer folds."""
    labels = cohort.labels(spark)
    folds = resample.stratified_folds(labels, n_outer, seed)
    outer = _folds(cohort, folds)
    inner = np.full((n_outer, len(cohort.ids)), -1, np.int16)
    got = resample.inner_folds(folds, n_inner, seed, n_outer).select("outer", "id", "inner").toArrow()
    inner[got["outer"].to_numpy(), pd.Index(cohort.ids).get_indexer(got["id"].to_pandas())] = got["inner"].to_numpy()
    grids = grids or {m: model(m).combinations() for m in names}
    few = [m for m in names if model(m).votes is None]
    tasks = [(m, o, i, ks) for m in few for ks in model(m).runs(grids[m]) for o in range(n_outer) for i in range(n_inner)]
    alone = any(model(m).kind == "tree" for m in few) or cohort.x.size > SMALL
    held, known = (spark.sparkContext.broadcast(v) for v in (cohort.x, (cohort.y, inner, grids)))

    def sides(o: int, i: int) -> tuple[np.ndarray, np.ndarray] | None:
        """Training and test rows, if both hold both classes."""
        y, inner, _ = known.value
        train, test = (inner[o] >= 0) & (inner[o] != i), inner[o] == i
        return (train, test) if len(set(y[train])) == 2 and len(set(y[test])) == 2 else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x, (y, _, grids) = held.value, known.value
        for m, o, i, ks in (tasks[k] for batch in batches for k in batch["id"]):
            aucs = [None] * len(ks)
            if rows := sides(o, i):
                made = MODELS[m].fits(x[rows[0]], y[rows[0]], [grids[m][k] for k in ks], seed)
                aucs = [auc_of(y[rows[1]], fit.proba(x[rows[1]])) for fit in made]
            yield pd.DataFrame([(m, o, k, auc) for k, auc in zip(ks, aucs)], columns=["model", "outer", "combo", "auc"])

    dealt = [(m, o, i, part) for m in names if m not in few for o in range(n_outer) for i in range(n_inner) for part in model(m).parts(max(c["trees"] for c in grids[m]))]

    def grow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x, (y, _, grids) = held.value, known.value
        for m, o, i, part in (dealt[k] for batch in batches for k in batch["id"]):
            if rows := sides(o, i):
                for k, total in enumerate(MODELS[m].votes(x[rows[0]], y[rows[0]], grids[m], part, x[rows[1]], seed)):
                    yield pd.DataFrame({"model": m, "outer": o, "inner": i, "combo": k, "part": part.start, "total": [total.tobytes()]})

    def judge(parts: pd.DataFrame) -> pd.DataFrame:
        y, _, grids = known.value
        m, o, i, k = (parts[c].iloc[0] for c in ("model", "outer", "inner", "combo"))
        p = 1 / int(grids[m][k]["trees"]) * sum(np.frombuffer(t) for t in parts.sort_values("part")["total"])
        return pd.DataFrame([(m, o, k, auc_of(y[sides(o, i)[1]], p))], columns=["model", "outer", "combo", "auc"])

    auc = "model string, outer int, combo int, auc double"
    scored = spark.createDataFrame([], auc)
    if tasks:
        scored = scored.unionByName(_each(spark, len(tasks), alone).mapInPandas(run, auc))
    if dealt:
        totals = _each(spark, len(dealt), True).mapInPandas(grow, "model string, outer int, inner int, combo int, part int, total binary")
        own = totals.groupBy("model", "outer", "inner", "combo").applyInPandas(judge, auc)
        every = spark.createDataFrame([(m, o, k) for m in names if m not in few for o in range(n_outer) for k in range(len(grids[m]))], "model string, outer int, combo int")
        scored = scored.unionByName(every.join(own, ["model", "outer", "combo"], "left"))
    mean = scored.groupBy("model", "outer", "combo").agg(F.avg("auc").alias("auc"))
    combos = spark.createDataFrame([(m, k, _params(c)) for m in names for k, c in enumerate(grids[m])], f"model string, combo int, params {PARAMS}")
    return mean.join(combos, ["model", "combo"]), outer


def _clean(p) -> dict:
    p = p.asDict() if hasattr(p, "asDict") else dict(p)
    return {k: (None if v is None or v != v else v) for k, v in p.items()}


def auc_of(y: np.ndarray, p: np.ndarray) -> float:
    order = np.argsort(p, kind="stable")
    s = p[order]
    head = np.concatenate([[True], s[1:] != s[:-1]])
    first = np.flatnonzero(head)
    last = np.concatenate([first[1:], [len(s)]])
    rank = np.empty(len(s))
    rank[order] = ((first + last + 1) / 2)[np.cumsum(head) - 1]
    m = y.sum()
    return float((rank[y == 1].sum() - m * (m + 1) / 2) / (m * (len(y) - m)))


@dataclass
class NestedResult:
    best: DataFrame  # model, fold, params, inner_auc
    predictions: DataFrame  # model, id, fold, y, p, pred
    importances: DataFrame  # model, fold, feature, importance
    attributions: DataFrame  # model, id, fold, feature, shap: by the model that didn't see the row
    metrics: DataFrame  # model, fold, auc, balanced_accuracy, f1


def nested_cv(spark: SparkSession, cohort: Cohort, names: Sequence[str] = tuple(MODELS), n_outer: int = 5, n_inner: int = 5, seed: int = 42, grids: dict[str, list[dict]] | None = None) -> NestedResult:
    """Grid search inside each outer fold, the best combination (first among equals) fitted again
    on the fold's training rows and judged on its test rows."""
    scored, outer = grid_search(spark, cohort, names, n_outer, n_inner, seed, grids)
    order = Window.partitionBy("model", "outer").orderBy(F.desc_nulls_last("auc"), "combo")
    best = scored.withColumn("_r", F.row_number().over(order)).where("_r = 1").select("model", F.col("outer").alias("fold"), "params", F.col("auc").alias("inner_auc"))
    best = spark.createDataFrame(best.collect(), best.schema)  # one row for each model and outer fold
    # attributions cost more than all else: who doesn't ask for them doesn't wait for them
    fitted, attributed = (fit_folds(spark, cohort, best, outer, seed, attributions=own) for own in (False, True))
    predictions = fitted.where("kind = 'p'").select("model", "id", "fold", F.col("y"), F.col("value").alias("p"), F.col("pred"))
    return NestedResult(
        best,
        predictions,
        fitted.where("kind = 'i'").select("model", "fold", "feature", F.col("value").alias("importance")),
        attributed.select("model", "id", "fold", "feature", F.col("value").alias("shap")),
        fold_metrics(predictions, ["model", "fold"]),
    )


def fit_folds(spark: SparkSession, cohort: Cohort, best: DataFrame, outer: np.ndarray, seed: int, attributions: bool = False) -> DataFrame:
    """Predictions (kind p) and importances (i) of each fold's best model, or its attributions (s). Parts of a
    model that is dealt are summed, in their order."""
    held = spark.sparkContext.broadcast((cohort, outer))
    chosen = [(r["model"], r["fold"], _clean(r["params"])) for r in best.collect()]  # one row for each model and outer fold
    tasks = [(m, fold, p, part) for m, fold, p in chosen for part in model(m).parts(p["trees"])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c, outer = held.value
        for m, fold, p, part in (tasks[k] for batch in batches for k in batch["id"]):
            train, test = outer != fold, np.flatnonzero(outer == fold)
            fit = MODELS[m].fit(c.x[train], c.y[train], p, seed) if part is None else _part(c.x[train], c.y[train], p, part, seed)
            key = {"part": part.start if part else 0, "scale": 1 / int(p["trees"]) if part else 1.0, "model": m, "fold": fold}
            ids = [c.ids[i] for i in test]
            if attributions:
                for a in range(0, len(ids), SENT):  # a batch of some rows at a time
                    some, shap = ids[a : a + SENT], fit.attributions(c.x[test[a : a + SENT]])
                    yield pd.DataFrame({"kind": "s"} | key | {"id": np.repeat(some, len(c.features)), "feature": c.features * len(some), "y": 0, "value": shap.ravel(), "pred": 0})
                continue
            pred = fit.predict(c.x[test])
            yield pd.DataFrame({"kind": "p"} | key | {"id": ids, "feature": None, "y": c.y[test], "value": fit.proba(c.x[test]), "pred": pred})
            yield pd.DataFrame({"kind": "i"} | key | {"id": None, "feature": c.features, "y": 0, "value": fit.importance() if part is None else fit.gains(), "pred": 0})

    columns = ["kind", "model", "fold", "id", "feature", "y", "value", "pred"]
    fitted = _each(spark, len(tasks), True).mapInPandas(run, "kind string, part int, scale double, model string, fold int, id string, feature string, y int, value double, pred int")
    if all(part is None for *_, part in tasks):
        return fitted.select(*columns).persist()
    sums = F.aggregate(F.array_sort(F.collect_list(F.struct("part", "value"))), F.lit(0.0), lambda total, v: total + v["value"])
    whole = fitted.groupBy("kind", "model", "fold", "id", "feature").agg(F.max("y").alias("y"), F.max("scale").alias("scale"), sums.alias("value"), F.max("pred").alias("pred"))
    # of parts neither classes nor shares of importance add up
    cut = F.col("model").isin([m for m in MODELS if MODELS[m].votes])
    scaled = whole.where("kind <> 'i'").withColumn("value", F.col("scale") * F.col("value"))
    scaled = scaled.withColumn("pred", F.when(cut & (F.col("kind") == "p"), (F.col("value") > 0.5).cast("int")).otherwise(F.col("pred")))
    share = F.sum("value").over(Window.partitionBy("model", "fold"))  # a row for each feature
    shares = whole.where("kind = 'i'").withColumn("value", F.when(cut & (share > 0), F.col("value") / F.nullif(share, F.lit(0.0))).otherwise(F.col("value")))
    return scaled.unionByName(shares).select(*columns).persist()


def bootstrap_importances(spark: SparkSession, cohort: Cohort, name: str, params: dict, n_boot: int = 200, seed: int = 42) -> DataFrame:
    """(b, feature, importance) of a fixed model on resamples that hold both classes."""
    held = spark.sparkContext.broadcast(cohort)
    drawn = resample.bootstrap_counts(cohort.labels(spark), n_boot, seed)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        c = held.value
        at = {i: k for k, i in enumerate(c.ids)}
        index = np.repeat([at[i] for i in rows["id"]], rows["times"])
        index.sort()
        if len(set(c.y[index])) < 2:
            return pd.DataFrame(columns=["b", "feature", "importance"])
        fit = MODELS[name].fit(c.x[index], c.y[index], params, seed + int(rows["b"].iloc[0]))
        return pd.DataFrame({"b": rows["b"].iloc[0], "feature": c.features, "importance": fit.importance()})

    return drawn.groupBy("b").applyInPandas(run, "b int, feature string, importance double")


def cv_aucs(spark: SparkSession, cohort: Cohort, name: str, params: dict, n_perm: int, n_folds: int, seed: int) -> DataFrame:
    """(perm, auc): mean fold AUC of a fixed model for the cohort's labels (perm -1) and each permutation of them. A task
    permutes the labels of some itself: shuffled, each would be a table as long as the cohort's."""
    held = spark.sparkContext.broadcast(cohort)
    each = max(1, min(LABELLINGS, -(-(n_perm + 1) // (4 * spark.sparkContext.defaultParallelism))))
    groups = [range(a, min(n_perm, a + each)) for a in range(-1, n_perm, each)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c, order = held.value, None
        for perms in (groups[k] for batch in batches for k in batch["id"]):
            order = resample.hash_order(c.ids, seed) if order is None else order
            y = np.stack([c.y if b < 0 else resample.permuted_in_task(c.ids, c.y, b, seed) for b in perms]).astype(np.int8)
            fold = np.stack([resample.folds_in_task(order, own, n_folds) for own in y])
            p = model(name).out_of_fold(c.x, y, fold, n_folds, params, seed)
            for b, own, at, of in zip(perms, y, fold, p):
                tests = [(own[at == k], of[at == k]) for k in range(n_folds)]
                aucs = [auc_of(t.astype(int), q) for t, q in tests if len(set(t)) == 2 and not np.isnan(q).any()]
                yield pd.DataFrame({"perm": [b], "auc": [float(np.mean(aucs)) if aucs else None]})

    return _each(spark, len(groups), True).mapInPandas(run, "perm int, auc double")


def permutation_test(spark: SparkSession, cohort: Cohort, name: str, params: dict, n_perm: int = 200, n_folds: int = 5, seed: int = 42) -> DataFrame:
    """(auc_real, auc) for each permutation."""
    aucs = cv_aucs(spark, cohort, name, params, n_perm, n_folds, seed)
    return aucs.withColumn("auc_real", F.max(F.when(F.col("perm") == -1, F.col("auc"))).over(Window.partitionBy())).where("perm >= 0").select("perm", "auc_real", "auc")
