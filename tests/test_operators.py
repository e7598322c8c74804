import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortia.functions import ranking, scalars
from cohortia.operators import align, consensus, hypothesis_tests, metrics, models, multiverse, reduction, resample
from cohortia.plans.study import Config, Study
from cohortia.sources import sheets, sinks


def rows(df, *keys):
    got = [r.asDict() for r in df.collect()]
    return sorted(got, key=lambda r: tuple(str(r[k]) for k in keys)) if keys else got


def test_ids_numbers_and_labels(spark):
    raw = spark.createDataFrame([(1, "Pz 012b"), (2, "12"), (3, " ABC "), (4, None), (5, "")], "k int, raw string")
    assert [r["id"] for r in rows(raw.select("k", scalars.normalize_id(F.col("raw")).alias("id")), "k")] == ["012", "12", "ABC", None, ""]
    num = spark.createDataFrame([(1, "1,5"), (2, "1.5"), (3, "abc"), (4, ""), (5, " 3 "), (6, None)], "k int, raw string")
    assert [r["v"] for r in rows(num.select("k", scalars.parse_decimal(F.col("raw")).alias("v")), "k")] == [1.5, 1.5, None, None, 3.0, None]
    assert rows(raw.select(scalars.clean_label(F.col("raw")).alias("l")).where("l is null")) == [{"l": None}, {"l": None}]


def test_transposed_sheets(spark):
    sheet = spark.createDataFrame([(" id ", "P1", "P2", "x", "y"), ("kind", " A ", None, "x", "y")], "a string, `1` string, `2` string, e1 string, e2 string")
    cells = sheets.transposed(sheets.drop_last(sheet, 2))
    assert rows(sheets.attribute(cells, "id", "kind", "label"), "id") == [{"id": "1", "label": "A"}, {"id": "2", "label": None}]
    assert sheets.attribute(cells, "id", "nothing", "label") is None
    block = sheets.feature_block(sheets.upright(spark.createDataFrame([("P 7", "1,5")], "id string, f string")), "rad")
    assert rows(block) == [{"id": "7", "block": "rad", "feature": "rad__f", "value": 1.5}]


def test_alignment(spark):
    long = spark.createDataFrame([("1", "rad", "rad__a", 1.0), ("1", "gen", "gen__b", 2.0), ("2", "rad", "rad__a", 3.0)], "id string, block string, feature string, value double")
    assert {r["id"] for r in rows(align.align_blocks(long, 2))} == {"1"}
    with pytest.raises(align.AlignmentError):
        align.require_unique(spark.createDataFrame([("1",), ("1",)], "id string"), ["id"])
    one = spark.createDataFrame([("1", 1, 0.2), ("2", 0, 0.3)], "id string, y int, p double")
    other = spark.createDataFrame([("1", 0, 0.2)], "id string, y int, p double")
    with pytest.raises(align.AlignmentError):
        align.pair_results(one, other)
    labels = spark.createDataFrame([("1", None), ("2", "A")], "id string, label string")
    assert {r["id"] for r in rows(align.with_labels(long, labels))} == {"2"}


def test_ranks_and_numbers(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([1, 2, 2, 5])], "k int, x double")
    assert [r["r"] for r in rows(df.withColumn("r", ranking.midrank([], "x")), "k")] == [1.0, 2.5, 2.5, 4.0]
    assert [r["r"] for r in rows(df.limit(1).withColumn("r", ranking.normalized_rank("x")))] == [0.0]
    keyed = spark.range(50).select((F.col("id") % 2).alias("y"), F.md5(F.col("id").cast("string")).alias("h"))
    got = sorted((r["y"], r["h"], r["n"]) for r in rows(ranking.numbered(keyed, ["y"], "h")))
    assert [n for _, _, n in got] == list(range(50))
    tied = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", 0.5)], "feature string, v double")
    assert rows(ranking.top_k(tied, [], "v", 1))[0]["feature"] == "a"


def test_reduction_ignores_constants_and_handles_one_feature(spark):
    cells = [(str(i), "rad", f, float(v)) for i in range(8) for f, v in (("rad__a", i), ("rad__b", 2 * i + 1), ("rad__c", 3), ("rad__shape_x", i * i % 5))]
    long = spark.createDataFrame(cells, "id string, block string, feature string, value double")
    kept = {r["feature"] for r in rows(reduction.neutral_reduction(long))}
    assert kept == {"rad__b", "rad__shape_x"}  # the larger variance of two that are one; shape apart
    with pytest.raises(ValueError):
        reduction.neutral_reduction(long.withColumn("block", F.lit("other")))
    with pytest.raises(ValueError):
        reduction.select_genes(long, "nothing")


def test_correlation_with_gaps_ranks_what_both_have(spark):
    a, b = [3, 1, 2, None, 5], [1, 2, None, 4, 7]
    cells = [(str(i), f, None if v is None else float(v)) for f, xs in (("a", a), ("b", b)) for i, v in enumerate(xs)]
    long = spark.createDataFrame(cells, "id string, feature string, value double")
    both = [(x, y) for x, y in zip(a, b) if x is not None and y is not None]
    r = [np.argsort(np.argsort([p[k] for p in both])) for k in (0, 1)]
    assert rows(reduction.correlations(long))[0]["rho"] == pytest.approx(np.corrcoef(*r)[0, 1])


def test_folds_are_balanced_and_ignore_order(spark):
    labels = spark.createDataFrame([(str(i), int(i % 4 == 0)) for i in range(43)], "id string, y int")
    one = {r["id"]: r["fold"] for r in rows(resample.stratified_folds(labels, 5, 1))}
    two = {r["id"]: r["fold"] for r in rows(resample.stratified_folds(labels.orderBy(F.desc("id")), 5, 1))}
    assert one == two
    for y in (0, 1):
        n = np.bincount([one[str(i)] for i in range(43) if int(i % 4 == 0) == y], minlength=5)
        assert n.max() - n.min() <= 1
    drawn = rows(resample.bootstrap_counts(labels, 3, 1))
    assert {b: sum(r["times"] for r in drawn if r["b"] == b) for b in range(3)} == {0: 43, 1: 43, 2: 43}
    perm = rows(resample.permuted_labels(labels, 4, 1))
    assert all(sum(r["y"] for r in perm if r["perm"] == p) == 11 for p in range(4))
    rare = spark.createDataFrame([(str(i), int(i == 0)) for i in range(12)], "id string, y int")
    usable = resample.usable_bootstraps(resample.bootstrap_counts(rare, 20, 1), 5)
    assert all(r["n"] == 2 for r in rows(usable.groupBy("b").agg(F.countDistinct("y").alias("n"))))


def test_auc_delong_and_metrics_against_pairs(spark):
    rng = np.random.default_rng(0)
    y = (rng.random(40) < 0.4).astype(int)
    a, b = np.round(rng.random(40) + y * 0.3, 1), np.round(rng.random(40), 1)
    df = spark.createDataFrame([(str(i), int(v), float(s), float(t)) for i, (v, s, t) in enumerate(zip(y, a, b))], "id string, y int, a double, b double")

    def kernel(p):
        return np.array([[(s > t) + 0.5 * (s == t) for t in p[y == 0]] for s in p[y == 1]])

    ka, kb = kernel(a), kernel(b)
    got = rows(hypothesis_tests.delong(df, []))[0]
    assert got["auc_a"] == pytest.approx(ka.mean()) and got["auc_b"] == pytest.approx(kb.mean())
    d = ka - kb
    var = d.mean(axis=1).var(ddof=1) / len(ka) + d.mean(axis=0).var(ddof=1) / ka.shape[1]
    assert got["se_diff"] == pytest.approx(math.sqrt(var))
    swapped = rows(hypothesis_tests.delong(df.select("id", "y", F.col("b").alias("a"), F.col("a").alias("b")), []))[0]
    assert swapped["diff"] == pytest.approx(-got["diff"])
    same = rows(hypothesis_tests.delong(df.select("id", "y", "a", F.col("a").alias("b")), []))[0]
    assert same["z"] == 0.0 and hypothesis_tests.delong_p(same) == 1.0
    one = rows(metrics.roc_auc(df.withColumnRenamed("a", "p"), []))[0]["auc"]
    mirrored = rows(metrics.roc_auc(df.withColumn("p", 1 - F.col("a")), []))[0]["auc"]
    assert one == pytest.approx(ka.mean()) and mirrored == pytest.approx(1 - one)
    single = df.where("y = 1").withColumnRenamed("a", "p")
    assert rows(metrics.roc_auc(single, []))[0]["auc"] is None
    weighted = df.withColumn("t", F.lit(3)).withColumnRenamed("a", "p")
    assert rows(metrics.roc_auc(weighted, [], weight="t"))[0]["auc"] == pytest.approx(one)


def test_oof_checks_and_histogram(spark):
    p = spark.createDataFrame([("m", "1", 0, 1, 0.5, 1), ("m", "1", 1, 1, 0.5, 1)], "model string, id string, fold int, y int, p double, pred int")
    ids = spark.createDataFrame([("1",), ("2",)], "id string")
    assert rows(metrics.oof_integrity(p, ids, ["model"])) == [{"model": "m", "n_ids": 1, "n_twice": 1, "n_never": 1, "n_bad_class": 0}]
    with pytest.raises(ValueError):
        metrics.require_sound(p, ids, ["model"])
    assert rows(metrics.histogram(p, "p", 20)) == [{"bin": 0, "n": 2}]
    none = p.withColumns({"y": F.lit(0), "pred": F.lit(0)})
    assert rows(metrics.confusion(none, ["model"]).select(metrics.f1().alias("f")))[0]["f"] == 0.0


def test_kruskal_and_tails(spark):
    df = spark.createDataFrame([(float(v), g) for g, vs in (("a", [1, 2, 2]), ("b", [3, 5, 6]), (None, [9])) for v in vs], "v double, g string")
    got = rows(hypothesis_tests.kruskal_wallis(df, "v", "g", []))[0]
    r = {"a": [1, 2.5, 2.5], "b": [4, 5, 6]}
    h = 12 / 42 * sum(sum(x) ** 2 / 3 for x in r.values()) - 21
    assert got["h"] == pytest.approx(h / (1 - 6 / (216 - 6))) and got["df"] == 1 and got["n"] == 6
    assert hypothesis_tests.chi2_upper(spark, 3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert hypothesis_tests.normal_two_sided(1.959964) == pytest.approx(0.05, abs=1e-6)


def test_consensus_votes_and_params(spark):
    stable = spark.createDataFrame([("a", 0.9)], "feature string, selection_frequency double")
    shap = spark.createDataFrame([("a", 0.5), ("b", 0.1)], "feature string, mean_abs_shap double")
    voted = spark.createDataFrame([("c", 4)], "feature string, n_specs_selected bigint")
    got = {r["feature"]: r for r in rows(consensus.consensus(stable, shap, voted))}
    assert got["a"]["n_criteria_present"] == 2 and got["c"]["rank_spec_votes"] == 1.0
    params = spark.createDataFrame([(0, "x"), (1, "y"), (2, "y"), (3, "x")], "fold int, params string")
    assert rows(consensus.majority_params(params, []))[0]["params"] == "x"
    assert multiverse.distinct_specs(multiverse.spec_grid(spark)).count() == 33
    zero = spark.createDataFrame([("a", 0.0), ("a", 0.0)], "feature string, importance double")
    assert rows(consensus.collapsed(consensus.feature_stats(zero, []), []))[0]["collapsed_model"]


@pytest.fixture(scope="module")
def cohort(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(48, 5))
    y = ((x[:, 0] + 0.5 * rng.normal(size=48)) > 0).astype(int)
    return models.Cohort([f"{i:03d}" for i in range(48)], [f"f{j}" for j in range(5)], x, y)


def test_nested_cv_covers_each_row_once_and_finds_the_signal(spark, cohort):
    grids = {"elastic_net": [{"C": 0.1, "l1_ratio": 0.5}, {"C": 1.0, "l1_ratio": 0.1}], "random_forest": [{"trees": 20, "depth": 3, "leaf": 3}]}
    result = models.nested_cv(spark, cohort, list(grids), 3, 3, 1, grids)
    ids = cohort.labels(spark)
    metrics.require_sound(result.predictions, ids, ["model"])
    pooled = {r["model"]: r["pooled_oof_auc"] for r in rows(metrics.pooled(result.predictions, ["model"]))}
    assert min(pooled.values()) > 0.8
    assert {r["model"]: r["feature"] for r in rows(ranking.top_k(consensus.mean_abs(result.attributions.where("model = 'elastic_net'")), [], "mean_abs_shap", 1).withColumn("model", F.lit("e")))} == {"e": "f0"}
    boot = models.bootstrap_importances(spark, cohort, "elastic_net", {"C": 0.1, "l1_ratio": 0.5}, 8, 1)
    freq = {r["feature"]: r["selection_frequency"] for r in rows(consensus.stability(boot, ["b"], 1, 8))}
    assert freq["f0"] >= 0.9
    perms = hypothesis_tests.permutation_summary(models.permutation_test(spark, cohort, "elastic_net", {"C": 0.1, "l1_ratio": 0.5}, 9, 3, 1))
    assert rows(perms)[0]["p_value"] == pytest.approx(0.1)
    with pytest.raises(ValueError):
        models.model("nothing")


def test_changing_a_test_row_leaves_its_fold_model_alone(spark, cohort):
    grids = {"elastic_net": [{"C": 0.1, "l1_ratio": 0.5}]}
    before = models.nested_cv(spark, cohort, ["elastic_net"], 3, 2, 1, grids)
    fold = rows(before.predictions.where("id = '000'"))[0]["fold"]
    x = cohort.x.copy()
    x[0] += 5
    after = models.nested_cv(spark, models.Cohort(cohort.ids, cohort.features, x, cohort.y), ["elastic_net"], 3, 2, 1, grids)
    own = lambda r: rows(r.importances.where(F.col("fold") == fold), "feature")
    assert own(before) == own(after)


def test_study_end_to_end(spark, tmp_path):
    rng = np.random.default_rng(2)
    n = 40
    y = rng.integers(0, 2, n)
    cells = []
    for i in range(n):
        base = rng.normal()
        values = {"rad__a": y[i] + 0.4 * rng.normal(), "rad__b": base, "rad__shape_s": base * 2, "gen__g": rng.normal(), "gen__h": rng.normal() + y[i]}
        cells += [(str(i), f[:3], f, float(v)) for f, v in values.items()]
    long = spark.createDataFrame(cells, "id string, block string, feature string, value double")
    labels = spark.createDataFrame([(str(i), "P" if v else "N") for i, v in enumerate(y)], "id string, label string")
    config = Config(positive="P", n_outer=3, n_inner=2, n_bootstrap=4, n_permutations=5, gene_method="variance", models=("elastic_net",), grids={"elastic_net": [{"C": 0.1, "l1_ratio": 0.5}]})
    study = Study(spark, long, labels, config, batches=labels.withColumnRenamed("label", "batch"))
    out = study.run(str(tmp_path), "both")
    assert out["best_model"] == "elastic_net"
    assert spark.read.parquet(f"{tmp_path}/both/pooled").count() == 1
    found = study.diagnose(str(tmp_path), "both")
    assert found["permutation"].count() == 1 and found["batch"].count() == 1
    path = sinks.write_table(labels, str(tmp_path), "x", "csv", format="csv")
    assert sheets.read_results(spark, path, "id string, label string", "csv").count() == n
