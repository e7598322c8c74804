"""Cases that reviews found at larger tables: work and memory of fits."""

import tracemalloc

import numpy as np
import pytest

from cohortia.operators import models, resample, solvers


def cohort_of(n, p=8, seed=5, places=None):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p))
    x = x if places is None else np.round(x, places)
    return x, (x[:, 0] - x[:, 1] + 2 * rng.normal(size=n) > 0).astype(int)


def same_trees(one, two):
    assert len(one) == len(two)
    for s, t in zip(one, two):
        for name in ("feature", "left", "right"):
            assert np.array_equal(getattr(s, name), getattr(t, name))
        for name in ("threshold", "value", "cover", "gain"):
            assert np.allclose(getattr(s, name), getattr(t, name), rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("places", [None, 1])
@pytest.mark.parametrize("leaf, ridge", [(1.0, 1.0), (5.0, 0.0)])
def test_splits_found_by_bins_are_those_of_all_rows(monkeypatch, places, leaf, ridge):
    x, y = cohort_of(3000, places=places)
    rng = np.random.default_rng(2)
    g, h = rng.normal(size=len(x)) - y, rng.uniform(0.1, 0.3, len(x)) if ridge else np.ones(len(x))
    g = g if ridge else -1.0 * y
    trees = {}
    for large in (64, 1 << 30):
        monkeypatch.setattr(solvers, "LARGE", large, raising=False)
        columns = solvers.Columns(x)
        trees[large] = [solvers.grow_one(columns, g, h, 4, leaf, ridge), *solvers.grow_many(columns, g[None], h[None], 4, leaf, ridge, 3, np.arange(1))]
    same_trees(trees[64], trees[1 << 30])
    assert len(trees[64][0].feature) > 20


def test_boosting_searches_few_cells_row_by_row(monkeypatch):
    x, y = cohort_of(20_000, 16)
    seen, within = [], solvers.Columns.within
    monkeypatch.setattr(solvers.Columns, "within", lambda self, tried, rows, *rest: (found := within(self, tried, rows, *rest), seen.append((len(found[0]), len(rows) * len(tried))))[0])
    solvers.boosted_trees(x, y, 5, 3, 0.1)
    searched, cells = np.sum(seen, axis=0)
    assert searched < cells / 5


def test_boosting_holds_no_copies_of_its_columns():
    x, y = cohort_of(20_000, 16)
    tracemalloc.start()
    solvers.boosted_trees(x, y, 3, 3, 0.1)
    top = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert top < 4 * x.nbytes


def test_forests_of_all_leaves_grow_together():
    x, y = cohort_of(700, places=1)
    together = solvers.random_forests(x, y, range(4, 9), None, (1, 3, 5), 3)
    for leaf, forest in together.items():
        same_trees(forest.trees, solvers.random_forest(x, y, 9, None, leaf, 3).trees[4:])


def test_a_search_sorts_rows_once_for_all_leaves(monkeypatch):
    x, y = cohort_of(400)
    forest, sorted_, split = models.model("random_forest"), [], solvers._split_small
    monkeypatch.setattr(solvers, "_split_small", lambda columns, row, *rest: sorted_.append(len(row)) or split(columns, row, *rest))
    combos = [c | {"trees": c["trees"] // 50} for c in forest.combinations()]
    forest.votes(x, y, combos, range(10), x, 3)
    together = sum(sorted_)
    sorted_.clear()
    for leaf in (1, 3, 5):
        solvers.random_forest(x, y, 10, None, leaf, 3)
    assert together < 0.6 * sum(sorted_)


def test_trees_of_a_forest_are_dealt_to_tasks(spark, monkeypatch):
    monkeypatch.setattr(models, "DEAL", 7)
    x, y = cohort_of(90, 4)
    cohort = models.Cohort([f"{i:03d}" for i in range(90)], list("abcd"), x, y)
    grid = [{"trees": t, "depth": d, "leaf": leaf} for t in (10, 20) for d in (2, None) for leaf in (1, 4)]
    forest = models.model("random_forest")
    assert [list(p) for p in forest.parts(20)] == [list(range(7)), list(range(7, 14)), list(range(14, 20))]
    scored, outer = models.grid_search(spark, cohort, ["random_forest"], 2, 2, 3, {"random_forest": grid})
    got = {(r["outer"], r["combo"]): r["auc"] for r in scored.collect()}
    assert len(got) == 16 and all(0.4 < v <= 1 for v in got.values())
    result = models.nested_cv(spark, cohort, ["random_forest"], 2, 2, 3, {"random_forest": [grid[7]]})
    p = {r["id"]: (r["p"], r["pred"]) for r in result.predictions.collect()}
    shap = {(r["id"], r["feature"]): r["shap"] for r in result.attributions.collect()}
    share = {(r["fold"], r["feature"]): r["importance"] for r in result.importances.collect()}
    for fold in (0, 1):
        train, test = outer != fold, np.flatnonzero(outer == fold)
        alone = forest.fit(x[train], y[train], grid[7], 3)
        assert np.allclose([p[cohort.ids[i]][0] for i in test], alone.proba(x[test]), atol=1e-12)
        assert [p[cohort.ids[i]][1] for i in test] == alone.predict(x[test]).tolist()
        assert np.allclose([[shap[cohort.ids[i], f] for f in "abcd"] for i in test], alone.attributions(x[test]), atol=1e-12)
        assert np.allclose([share[fold, f] for f in "abcd"], alone.importance(), atol=1e-12)


def long_of(spark, x, y):
    long = spark.createDataFrame([(f"{i:04d}", f"f{j}", float(v)) for i, row in enumerate(x) for j, v in enumerate(row)], "id string, feature string, value double")
    return long, spark.createDataFrame([(f"{i:04d}", int(v)) for i, v in enumerate(y)], "id string, y int")


def test_a_cohort_of_any_size_is_taken_in_the_least_bytes(spark, monkeypatch):
    of = models.Cohort.of.__func__
    if of.__defaults__:
        monkeypatch.setattr(of, "__defaults__", (10,))
    x, y = cohort_of(40, 3)
    short = models.Cohort.of(*long_of(spark, x.astype(np.float32).astype(float), y))
    assert short.x.dtype == np.float32 and np.array_equal(short.x, x.astype(np.float32)) and short.y.tolist() == y.tolist()
    assert np.array_equal(models.Cohort.of(*long_of(spark, x, y)).x, x)
    missing = x.copy()
    missing[3, 1] = np.nan
    with pytest.raises(ValueError):
        models.Cohort.of(*long_of(spark, missing, y))


@pytest.mark.parametrize("name", ["elastic_net", "svm_linear", "random_forest", "gbt"])
def test_fits_of_short_numbers_are_those_of_long_ones(name):
    x, y = cohort_of(200, 4)
    x = x.astype(np.float32)
    spec = models.model(name)
    combo = spec.combinations()[-1] | ({"trees": 5} if spec.kind == "tree" else {})
    assert np.allclose(spec.fit(x, y, combo, 1).proba(x), spec.fit(x.astype(float), y, combo, 1).proba(x.astype(float)), atol=1e-9)


def test_an_svm_holds_few_copies_of_its_rows():
    x, y = cohort_of(30_000, 32)
    tracemalloc.start()
    solvers.linear_svm(x, y, 0.1)
    top = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert top < 2.2 * x.nbytes


def test_fits_of_all_folds_and_labellings_are_those_of_each():
    x, y = cohort_of(300, 5)
    x[:, 4] = 2.5
    x[:, 3] = x[:, 3] * 1e3 + 1e4
    rng = np.random.default_rng(1)
    ys = np.stack([y, rng.permutation(y), np.arange(300) < 1]).astype(np.int8)
    folds = np.stack([np.arange(300) % 3] * 3).astype(np.int16)
    elastic_net = models.model("elastic_net")
    for params in ({"C": 0.1, "l1_ratio": 0.5}, {"C": 1.0, "l1_ratio": 0.05}):
        p = elastic_net.out_of_fold(x, ys, folds, 3, params, 1)
        for one in range(3):
            for f in range(3):
                train, test = folds[one] != f, folds[one] == f
                if len(set(ys[one][train])) < 2:
                    assert np.isnan(p[one][test]).all()
                    continue
                assert np.allclose(p[one][test], elastic_net.fit(x[train], ys[one][train].astype(int), params, 1).proba(x[test]), atol=1e-7)


def test_labels_are_permuted_in_tasks_as_in_tables(spark):
    ids, y = [f"é{i}" for i in range(50)], np.arange(50) % 3 // 2
    labels = spark.createDataFrame([(i, int(v)) for i, v in zip(ids, y)], "id string, y int")
    table = resample.permuted_labels(labels, 3, 7)
    folds = {(r["perm"], r["id"]): (r["y"], r["fold"]) for r in resample.stratified_folds(table, 4, 7, ("perm",)).collect()}
    order = resample.hash_order(ids, 7)
    for perm in range(3):
        own = resample.permuted_in_task(ids, y, perm, 7)
        assert [(int(a), int(b)) for a, b in zip(own, resample.folds_in_task(order, own, 4))] == [folds[perm, i] for i in ids]


def test_a_permutation_test_shuffles_no_labels(spark, monkeypatch):
    x, y = cohort_of(40, 3)
    monkeypatch.setattr(resample, "permuted_labels", lambda *a: pytest.fail("a table of labels for each permutation"))
    for name, params in (("elastic_net", {"C": 0.1, "l1_ratio": 0.5}), ("gbt", {"trees": 2, "depth": 1, "rate": 0.1})):
        got = models.permutation_test(spark, models.Cohort([str(i) for i in range(40)], list("abc"), x, y), name, params, 5, 4, 1).collect()
        assert len(got) == 5 and len({r["auc_real"] for r in got}) == 1
