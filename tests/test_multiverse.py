"""The specification curve in one plan, paths, tiles, linkage by components, ranks by ranges, resamples, tails."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortia.functions import ranking, tails
from cohortia.operators import attribution, hypothesis_tests, multiverse, reduction, resample, solvers


def study(n=40, seed=3):
    r = np.random.default_rng(seed)
    y = r.integers(0, 2, n)
    cells = []
    for i in range(n):
        a, b = r.normal(), r.normal()
        values = {"a": y[i] + 0.5 * r.normal(), "b": a, "c": a + 0.15 * r.normal(), "shape_d": a + 0.3 * r.normal(), "shape_e": b, "k": 1.0}
        cells += [(str(i), "rad", f"rad__{f}", float(v)) for f, v in values.items()]
        values = {"g": b, "h": b + 0.2 * r.normal(), "i": 3 * r.normal(), "j": y[i] + r.normal()}
        cells += [(str(i), "gen", f"gen__{f}", float(v)) for f, v in values.items()]
    return cells, [(str(i), int(v)) for i, v in enumerate(y)]


LONG = "id string, block string, feature string, value double"


def test_specifications_of_one_plan_keep_what_each_alone_keeps(spark):
    long = spark.createDataFrame(study()[0], LONG)
    grid = multiverse.GRID | {"gene_selection_method": ("variance", "iqr_top_pct"), "redundancy_corr_threshold": (0.8, 0.95)}
    got = multiverse.spec_features(long, multiverse.spec_grid(spark, grid)).collect()
    assert sum(r["multiplicity"] for r in got) == 24 and len({tuple(r[:4]) for r in got}) == len(got)
    blocks = {"imaging": ["rad"], "genes": ["gen"], "both": ["rad", "gen"]}
    for r in got:
        alone = reduction.neutral_reduction(long.where(F.col("block").isin(blocks[r["data_source"]])), r["gene_selection_method"] or "variance", bool(r["exclude_shape"]), r["redundancy_corr_threshold"])
        assert r["names"] == sorted(x["feature"] for x in alone.collect())


def test_whole_curve_of_a_small_grid(spark):
    cells, labels = study()
    grid = multiverse.GRID | {"gene_selection_method": ("variance", "iqr_top_n"), "redundancy_corr_threshold": (0.9,)}
    out = multiverse.spec_curve(spark, spark.createDataFrame(cells, LONG), spark.createDataFrame(labels, "id string, y int"), multiverse.spec_grid(spark, grid), n_folds=3, top=2, trees=8)
    curve = out["curve"].toPandas()
    assert sorted(curve["position"]) == list(range(1, len(curve) + 1)) and set(curve["model_type"]) == {"linear", "tree"}
    assert curve.groupby("model_type")["multiplicity"].sum().tolist() == [12, 12]
    assert curve[curve.data_source == "both"]["auc_pooled"].max() > 0.7
    votes = {r["feature"]: r["n_specs_selected"] for r in out["votes"].collect()}
    by_model = out["votes_by_model"].groupBy("feature").agg(F.sum("n_specs_selected").alias("n")).collect()
    assert votes == {r["feature"]: r["n"] for r in by_model}
    assert out["stats"].where("model_type = 'tree' and fraction_positive is not null").count() == 0
    # the linear model by its definition: a search in each fold, each fit from nothing
    features = next(r["names"] for r in multiverse.spec_features(spark.createDataFrame(cells, LONG), multiverse.spec_grid(spark, grid)).collect() if r["data_source"] == "imaging" and r["exclude_shape"])
    cohort = multiverse.Cohort.of(spark.createDataFrame(cells, LONG), spark.createDataFrame(labels, "id string, y int"))
    x, y = cohort.x[:, [cohort.features.index(f) for f in features]], cohort.y
    fold_of = {r["id"]: r["fold"] for r in resample.stratified_folds(cohort.labels(spark), 3, 42).collect()}
    outer = np.array([fold_of[i] for i in cohort.ids])
    aucs = []
    for k in range(3):
        tx, ty = x[outer != k], y[outer != k]
        place = multiverse.inner_places(ty, 42)
        score = {(c, r): np.mean([multiverse.auc_of(ty[place == f], solvers.elastic_net(tx[place != f], ty[place != f], c, r).proba(tx[place == f])) for f in range(3)]) for c in multiverse.LINEAR_C for r in multiverse.LINEAR_L1}
        c, r = max(score, key=lambda p: (round(score[p], 9), -p[0], -p[1]))
        aucs.append(multiverse.auc_of(y[outer == k], solvers.elastic_net(tx, ty, c, r).proba(x[outer == k])))
    own = curve[(curve.model_type == "linear") & (curve.data_source == "imaging") & (curve.exclude_shape == True)]  # noqa: E712
    assert own["auc_mean_fold"].tolist() == pytest.approx([np.mean(aucs)] * len(own))


def test_paths_equal_cold_fits():
    r = np.random.default_rng(1)
    x = r.normal(size=(60, 8))
    y = (x[:, 0] + r.normal(size=60) > 0).astype(int)
    cs = (0.5, 0.01, 5.0, 0.1)
    for ratio in (0.1, 0.9):
        for c, fit in zip(cs, solvers.elastic_net_path(x, y, cs, ratio, 20_000, 1e-11)):
            cold = solvers.elastic_net(x, y, c, ratio, 20_000, 1e-11)
            assert np.abs(fit.coef - cold.coef).max() < 1e-6 and abs(fit.intercept - cold.intercept) < 1e-6


@pytest.mark.parametrize(("method", "mode"), [(m, k) for m in ("pearson", "spearman") for k in ("whole", "tiles", "chunks")])
def test_correlations_by_tiles(spark, monkeypatch, method, mode):
    if mode == "tiles":
        monkeypatch.setattr(reduction, "COLUMNS", 2)
    if mode == "chunks":
        monkeypatch.setattr(reduction, "WHOLE", 3)
    gaps = not (mode == "chunks" and method == "spearman")
    r = np.random.default_rng(0)
    rows = []
    for g in "ab":
        x = r.normal(size=(30, 7)).round(1)
        x[:, 3], x[:, 6] = x[:, 2] + r.normal(size=30) * 0.1, 1.0
        if g == "b" and gaps:
            x[r.random(x.shape) < 0.2] = np.nan
        rows += [(g, str(i), f"f{j}", float(x[i, j])) for i in range(30) for j in range(7) if not np.isnan(x[i, j])]
    long = spark.createDataFrame(rows, "g string, id string, feature string, value double")
    got = {(x["g"], x["i"], x["j"]): x["rho"] for x in reduction.correlations(long, method, ("g",)).collect()}
    table = pd.DataFrame(rows, columns=["g", "id", "f", "v"])
    for g in "ab":
        want = table[table.g == g].pivot(index="id", columns="f", values="v").corr(method)
        for i in want.columns:
            for j in want.columns[want.columns > i]:
                assert got[g, i, j] == (None if "f6" in (i, j) else pytest.approx(want.loc[i, j], abs=1e-12))
    assert len(got) == 42


def test_ranks_of_long_columns_with_gaps_are_refused(spark, monkeypatch):
    monkeypatch.setattr(reduction, "WHOLE", 3)
    rows = [(str(i), f, float(i)) for i in range(8) for f in "ab" if (i, f) != (2, "a")]
    with pytest.raises(ValueError):
        reduction.correlations(spark.createDataFrame(rows, "id string, feature string, value double")).collect()


def test_linkage_by_components_equals_linkage_of_all(spark):
    r = np.random.default_rng(6)
    base = r.normal(size=(25, 9))
    x = np.concatenate([base[:, [k]] + r.normal(size=(25, 6)) * s for k, s in zip(range(9), r.uniform(0.05, 1.2, 9))], axis=1)
    names = [f"f{j:02d}" for j in range(x.shape[1])]
    rows = [("g", str(i), f, float(v)) for i, row in enumerate(x) for f, v in zip(names, row)]
    long = spark.createDataFrame(rows, "reduction_group string, id string, feature string, value double")
    d = 1 - np.abs(pd.DataFrame(x).corr("spearman").to_numpy())
    cut = reduction.cut_clusters(reduction.correlations(long, by=("reduction_group",)), long, (0.9, 0.6, 0.75)).collect()
    for t in (0.6, 0.75, 0.9):
        want = {f: names[k] for f, k in zip(names, reduction.average_linkage(d, 1 - t + 1e-12))}
        assert {c["feature"]: c["cluster"] for c in cut if c["threshold"] == t} == want
        assert {c["feature"]: c["cluster"] for c in reduction.clusters(long, t).collect()} == want


def test_components_of_chains_and_of_groups(spark):
    pairs = [("g", f"n{i:02d}", f"n{i + 1:02d}") for i in range(30)] + [("h", "n00", "n05"), ("h", "x", "y")]
    got = {(r["g"], r["feature"]): r["component"] for r in reduction.close_components(spark.createDataFrame(pairs, "g string, i string, j string"), ["g"]).collect()}
    assert {v for (g, _), v in got.items() if g == "g"} == {"n00"} and got["h", "n05"] == "n00" and got["h", "y"] == "x" and len(got) == 35


def test_principal_components(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(30, 5)) @ r.normal(size=(5, 5))
    rows = [(str(i), f"f{j}", float(v)) for i, row in enumerate(x) for j, v in enumerate(row)] + [(str(i), "same", 2.0) for i in range(30)]
    got = {r["id"]: r for r in multiverse.pca(spark.createDataFrame(rows, "id string, feature string, value double")).collect()}
    z = (x - x.mean(0)) / x.std(0)
    u, s, vt = np.linalg.svd(z, full_matrices=False)
    for k in range(2):
        score = u[:, k] * s[k] * np.sign(vt[k][np.abs(vt[k]).argmax()])
        assert [got[str(i)][f"pc{k + 1}"] for i in range(30)] == pytest.approx(score.tolist())
        assert got["0"][f"explained{k + 1}"] == pytest.approx(s[k] ** 2 / (s**2).sum())


def test_ranks_and_quantiles_by_ranges(spark):
    r = np.random.default_rng(0)
    rows = [(g, None if r.random() < 0.1 else round(float(r.normal()), 1), i) for g in ("a", None, "c") for i in range(700)]
    df = spark.createDataFrame(rows, "g string, v double, i int")
    want = {(x["g"], x["i"]): x["r"] for x in df.withColumn("r", ranking.midrank(["g"], "v")).collect()}
    got = ranking.with_midrank(df, ["g"], "v", "r").collect()
    assert len(got) == 2100 and {(x["g"], x["i"]): x["r"] for x in got} == want
    shares = [0.0, 0.025, 0.25, 0.5, 0.975, 1.0]
    for x in ranking.quantiles(df, ["g"], "v", shares).collect():
        own = [v for g, v, _ in rows if g == x["g"] and v is not None]
        assert x["q"] == pytest.approx(np.percentile(own, [100 * s for s in shares]).tolist())
    assert ranking.quantiles(df.where("v is null"), [], "v", [0.5]).first()["q"] == [None]


def test_dependence_finds_the_interaction(spark):
    r = np.random.default_rng(4)
    n = 120
    x = {"a": r.normal(size=n).round(1), "b": r.normal(size=n), "c": r.normal(size=n), "k": np.ones(n)}
    shap = {"a": x["a"] * (1 + x["c"]) * 3, "b": 0.2 * x["b"], "c": 0.1 * x["c"], "k": np.zeros(n)}
    frame = lambda t, name: spark.createDataFrame([(str(i), f, float(t[f][i])) for f in t for i in range(n)], f"id string, feature string, {name} double")
    got = attribution.dependence(frame(shap, "shap"), frame(x, "value"), 2).collect()
    assert len(got) == 2 * n and {r["feature"] for r in got} == {"a", "b"}
    want = {}
    for f in ("a", "b"):
        order = sorted(range(n), key=lambda i: (x[f][i], str(i)))
        strength = {}
        for o in sorted(set(x) - {f}):
            total = 0
            for k in range(10):
                own = [i for at, i in enumerate(order) if at * 10 // n == k]
                s, v = shap[f][own], x[o][own]
                total += len(own) * (abs(np.corrcoef(s, v)[0, 1]) if s.std() > 1e-12 and v.std() > 1e-12 else 0)
            strength[o] = round(total / n, 9)
        want[f] = max(sorted(strength), key=strength.get)
    assert {(r["feature"], r["interaction"]) for r in got} == set(want.items()) and want["a"] == "c"
    for r_ in got:
        i = int(r_["id"])
        assert (r_["value"], r_["shap"], r_["interaction_value"]) == (x[r_["feature"]][i], shap[r_["feature"]][i], x[r_["interaction"]][i])


def test_smaller_forests_and_boosts_are_the_first_trees(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(70, 6)).round(1)
    y = (x[:, 0] + r.normal(size=70) > 0).astype(int)
    for fit in (lambda n: solvers.random_forest(x, y, n, None, 2, 3), lambda n: solvers.boosted_trees(x, y, n, 3, 0.1)):
        assert np.allclose(fit(60).first(20).proba(x), fit(20).proba(x))
        assert np.allclose(fit(60).first(20).attributions(x[:3]), fit(20).attributions(x[:3]))


def test_trees_grown_together_equal_trees_grown_node_by_node():
    r = np.random.default_rng(6)
    x = r.normal(size=(50, 4))
    y = (x[:, 0] * x[:, 1] > 0).astype(int)
    w = np.stack([np.bincount(r.integers(0, 50, 50), minlength=50) for _ in range(5)]).astype(float)
    for depth, leaf in ((3, 3), (None, 2)):
        many = solvers.grow_many(solvers.Columns(x), -w * y, w, depth, leaf, 0.0, 4, np.arange(5))
        for k in range(5):
            one = solvers.grow(x, -w[k] * y, w[k], depth, leaf, 0.0, 4, np.random.default_rng(0))
            assert np.sort(many[k].gain) == pytest.approx(np.sort(one.gain)) and many[k].cover[0] == 50
            (alone,) = solvers.grow_many(solvers.Columns(x), -w[[k]] * y, w[[k]], depth, leaf, 0.0, 4, np.arange(5)[[k]])
            assert np.array_equal(alone(x), many[k](x))
            (few,) = solvers.grow_many(solvers.Columns(x), -w[[k]] * y, w[[k]], depth, leaf, 0.0, 2, np.arange(5)[[k]])
            assert len(few.feature) > 1


def test_tails_as_columns(spark):
    z = [0.0, 1e-8, 0.01, 0.5, 1.0, 1.4, 1.5, 1.959964, 3.0, 5.0, 8.0, 20.0, 37.0]
    for x in spark.createDataFrame([(v,) for v in z], "z double").select("z", tails.normal_tails(F.col("z")).alias("p")).collect():
        assert x["p"] == pytest.approx(math.erfc(x["z"] / math.sqrt(2)), rel=1e-10)
    cases = [(x, k) for k in (2, 4, 10, 40, 200) for x in (0.1, 1.0, 5.0, 20.0, 60.0, 150.0, 260.0)]
    for c in spark.createDataFrame(cases, "x double, k int").select("x", "k", tails.chi2_tail(F.col("x"), F.col("k")).alias("p")).collect():
        want = sum(math.exp(i * math.log(c["x"] / 2) - math.lgamma(i + 1) - c["x"] / 2) for i in range(c["k"] // 2))
        assert c["p"] == pytest.approx(want, abs=1e-10)
    assert spark.range(1).select(tails.chi2_tail(F.lit(None).cast("double"), F.lit(3))).first()[0] is None


def test_paired_resamples_of_a_rare_class(spark):
    r = np.random.default_rng(7)
    rows = [(str(i), int(i < 2), float(r.random()), float(r.random() + (i < 2))) for i in range(25)]
    pairs = spark.createDataFrame(rows, "id string, y int, a double, b double")
    got = {x["b"]: x["diff"] for x in hypothesis_tests.paired_auc_diffs(pairs, 60, 5).collect()}
    assert sorted(got) == list(range(60))  # one in eight has no positive at first
    at = {x["pos"]: x["id"] for x in resample.positions(pairs).collect()}
    import hashlib

    def auc(own, k):
        pos, neg = [rows[i][k] for i in own if rows[i][1]], [rows[i][k] for i in own if not rows[i][1]]
        return np.mean([(p > q) + 0.5 * (p == q) for p in pos for q in neg])

    again = 0
    for b in range(60):
        for attempt in range(20):
            middle = f"{b}:{attempt}" if attempt else f"{b}"
            own = [int(at[int(hashlib.md5(f"5:{middle}:{j}".encode()).hexdigest()[:12], 16) % 25]) for j in range(25)]
            if len({rows[i][1] for i in own}) == 2:
                break
        again += attempt > 0
        assert got[b] == pytest.approx(auc(own, 3) - auc(own, 2))
    assert again > 2
    drawn = resample.bootstraps(pairs, 60, 5).groupBy("b").agg(F.countDistinct("y").alias("k"), F.sum("times").alias("n")).collect()
    assert len(drawn) == 60 and all((x["k"], x["n"]) == (2, 25) for x in drawn)


def test_differences_are_b_less_a(spark):
    rows = [(str(i), i % 2, 0.5, float(i % 2)) for i in range(20)]
    pairs = spark.createDataFrame(rows, "id string, y int, a double, b double")
    got = hypothesis_tests.compared(pairs, hypothesis_tests.paired_auc_diffs(pairs, 20, 1)).first()
    assert (got["auc_a"], got["auc_b"], got["diff"]) == (0.5, 1.0, 0.5) and got["boot_ci_low"] == 0.5 and got["differs_by_interval"]
