"""Cases that reviews found: work of a task that grew with the rows."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortia.operators import models, reduction, resample, solvers


def test_large_resamples_have_a_task_each(spark, monkeypatch):
    monkeypatch.setattr(resample, "DRAWS_EACH", 50, raising=False)
    rows = resample.positions(spark.range(60).select(F.col("id").cast("string").alias("id"), (F.col("id") % 2).alias("y")))
    drawn = resample.draws(spark, rows, 60, range(40), 42)
    at = drawn.groupBy("b", F.spark_partition_id().alias("task")).agg(F.sum("times").alias("n")).collect()
    assert len(at) == 40 and {r["n"] for r in at} == {60}
    assert len({r["task"] for r in at}) == 40


@pytest.mark.parametrize("method", ["spearman", "pearson"])
def test_long_columns_are_dealt_into_chunks(spark, monkeypatch, method):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(400, 5)), 1)
    x[:, 1] += x[:, 0]
    long = spark.createDataFrame([(str(i), f"f{j}", float(x[i, j])) for i in range(400) for j in range(5)], "id string, feature string, value double")
    whole = {(r["i"], r["j"]): r["rho"] for r in reduction.correlations(long, method).collect()}
    monkeypatch.setattr(reduction, "SHORT", 100, raising=False)
    monkeypatch.setattr(reduction, "CHUNK_CELLS", 250, raising=False)
    found = reduction.correlations(long, method)
    assert "chunk" in found._jdf.queryExecution().analyzed().toString()
    assert {(r["i"], r["j"]): r["rho"] for r in found.collect()} == pytest.approx(whole, abs=1e-12)
    gaps = long.where("not (id = '7' and feature = 'f2')")
    want = pd.DataFrame(np.where((np.arange(400) == 7)[:, None] & (np.arange(5) == 2), np.nan, x)).corr(method)
    got = {(r["i"], r["j"]): r["rho"] for r in reduction.correlations(gaps, method).collect()}
    assert got == pytest.approx({(f"f{i}", f"f{j}"): want.iloc[i, j] for i in range(5) for j in range(i + 1, 5)}, abs=1e-12)


def few_rows(n=300, p=8, seed=5):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p))
    return x, (x[:, 0] - x[:, 1] + 2 * rng.normal(size=n) > 0).astype(int)


@pytest.mark.parametrize("c", [0.001, 0.1, 10.0, 1000.0])
def test_the_svm_reaches_its_minimum(c):
    x, y = few_rows()
    s = np.where(y > 0, 1, -1)
    loss = lambda v: v @ v / 2 + c * np.maximum(1 - s * (x @ v[:-1] + v[-1]), 0).sum()
    w, b = solvers._hinge(x, y, c)
    found = np.append(w, b)
    rng = np.random.default_rng(1)
    for way in [*np.eye(9), *-np.eye(9), *rng.normal(size=(200, 9))]:
        for far in (1e-3, 1e-2, 0.1):
            assert loss(found + far * way) >= loss(found) * (1 - 2e-8)


def equal_trees(one, two):
    assert len(one) == len(two)
    for s, t in zip(one, two):
        for name in ("feature", "left", "right"):
            assert (getattr(s, name) == getattr(t, name)).all()
        for name in ("threshold", "value", "cover", "gain"):
            assert np.allclose(getattr(s, name), getattr(t, name), atol=1e-12)


def test_a_search_grows_one_forest_for_all_depths_and_sizes():
    forest = models.model("random_forest")
    combos = forest.combinations()
    runs = forest.runs(combos)
    assert len(runs) == 3 and sorted(k for ks in runs for k in ks) == list(range(18))
    x, y = few_rows(120)
    combos = [c | {"trees": c["trees"] // 50} for c in combos]
    for ks in forest.runs(combos):
        for k, fit in zip(ks, forest.fits(x, y, [combos[k] for k in ks], 3)):
            alone = forest.fit(x, y, combos[k], 3)
            equal_trees(fit.trees, alone.trees)
            assert (fit.proba(x) == alone.proba(x)).all()


@pytest.mark.parametrize("cells", [1 << 16, 400])
@pytest.mark.parametrize("places", [None, 1])
def test_boosted_trees_split_known_orders(monkeypatch, cells, places):
    monkeypatch.setattr(solvers, "CELLS", cells, raising=False)
    x, y = few_rows(2000)
    x = x if places is None else np.round(x, places)
    columns, rng = solvers.Columns(x), np.random.default_rng(2)
    g, h = rng.normal(size=len(x)) - y, rng.uniform(0.1, 0.3, len(x))
    for depth in (1, 3, 5):
        many = solvers.grow_many(columns, g[None], h[None], depth, 1.0, 1.0, x.shape[1], np.zeros(1))
        equal_trees([solvers.grow_one(columns, g, h, depth, 1.0, 1.0)], many)


def test_forests_of_many_rows_grow_fewer_trees_together(monkeypatch):
    x, y = few_rows(500)
    want, seen, grow = solvers.random_forest(x, y, 12, 4, 2, 1), [], solvers.grow_many
    monkeypatch.setattr(solvers, "ROWS_TOGETHER", 1500, raising=False)
    monkeypatch.setattr(solvers, "grow_many", lambda c, g, h, *rest: seen.append(h.size) or grow(c, g, h, *rest))
    equal_trees(solvers.random_forest(x, y, 12, 4, 2, 1).trees, want.trees)
    assert max(seen) <= 1500 and len(seen) == 4


def test_rows_go_down_several_trees_at_once():
    x, y = few_rows(200)
    for m in (solvers.random_forest(x, y, 30, None, 1, 2), solvers.boosted_trees(x, y, 20, 3, 0.1)):
        assert (np.stack(list(m.values(x))) == np.stack([t(x) for t in m.trees])).all()
        assert (m.margin(x) == m.base + m.scale * sum(t(x) for t in m.trees)).all()


def test_a_search_without_attributions_makes_none(spark, monkeypatch):
    x, y = few_rows(60, 3)
    cohort = models.Cohort([str(i) for i in range(60)], ["a", "b", "c"], x, y)
    made, fit_folds = [], models.fit_folds
    monkeypatch.setattr(models, "fit_folds", lambda *a, **k: made.append(fit_folds(*a, **k)) or made[-1])
    result = models.nested_cv(spark, cohort, ["svm_linear"], 2, 2, 3, {"svm_linear": [{"C": 0.1}]})
    assert (result.predictions.count(), result.metrics.count(), result.importances.count()) == (60, 2, 6)
    assert {r["kind"] for r in made[0].select("kind").distinct().collect()} == {"p", "i"}
    assert result.attributions.count() == 180


def test_a_linear_fit_holds_one_copy_of_its_rows():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60_000, 32)) * rng.uniform(0.5, 20, 32) + 3
    y = (x[:, 0] + 10 * rng.normal(size=len(x)) > 3).astype(int)
    assert solvers._largest(solvers.Scaler.fit(x)(x)) == pytest.approx(np.linalg.norm((x - x.mean(axis=0)) / x.std(axis=0), 2), rel=1e-12)
    tracemalloc.start()
    solvers.elastic_net(x, y, 0.1, 0.5)
    top = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert top < 1.5 * x.nbytes
