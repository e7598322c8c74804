"""Sheets to a study, the comparison of two sources, and draws until there are enough."""

import json

import pytest
from pyspark.sql import functions as F

from cohortia.operators import reduction, resample
from cohortia.plans import study
from cohortia.sources import sheets, sinks


def _sheets(path):
    ids = [f"Pz {i:03d}" for i in range(6)]
    write = lambda name, rows: (path / name).write_text("\n".join(",".join(f'"{c}"' for c in row) for row in rows) + "\n")
    write("meta.csv", [["attribute", *[f"c{i}" for i in range(6)]], [" key ", *ids], [" kind ", *["ADK", "SCC"] * 3], ["lab", "x", "y", "x", "", "y", "x"]])
    write("rad.csv", [["id", "f1", "shape_f2"], *[[pz, f"{i},5", str(i * i)] for i, pz in enumerate(ids)]])
    write("gen.csv", [["gene", *[f"{i:03d} b" for i in range(6)], "e1", "e2"], *[[g, *[str(k * i) for i in range(6)], "0", "0"] for k, g in enumerate(["g1", "g2"], 1)]])
    return {"metadata": f"file://{path}/meta.csv", "imaging": f"file://{path}/rad.csv", "genes": f"file://{path}/gen.csv"}


@pytest.mark.parametrize(("source", "features"), [("imaging", {"rad__f1", "rad__shape_f2"}), ("genes", {"gen__g1", "gen__g2"}), ("both", {"rad__f1", "rad__shape_f2", "gen__g1", "gen__g2"})])
def test_study_from_sheets(spark, tmp_path, source, features):
    made = study.from_sheets(spark, key="key", label="kind", batch="lab", source=source, **_sheets(tmp_path))
    rows = made.long.collect()
    assert {r["feature"] for r in rows} == features
    assert len(rows) == len(made.labels.collect()) * len(features) if source != "both" else True
    assert {r["value"] for r in rows if r["feature"] == "rad__f1"} <= {i + 0.5 for i in range(6)}
    assert made.batches.where("batch is not null").count() == 5
    with pytest.raises(ValueError):
        study.from_sheets(spark, key="key", label="none", **_sheets(tmp_path))


def test_comparison_of_two_sources(spark, tmp_path):
    root = f"file://{tmp_path}"
    rows = [(str(i), i % 2, (i * 37 % 50) / 50 + 0.3 * (i % 2), (i * 11 % 50) / 50) for i in range(80)]
    for run, k in (("one", 2), ("two", 3)):
        df = spark.createDataFrame([("elastic_net", r[0], r[1], r[k]) for r in rows], "model string, id string, y int, p double")
        sinks.write_table(df, root, run, "predictions", ("model",))
    out = study.compare_sources(spark, root, "elastic_net", "one", "two", n_boot=30).first()
    assert out["auc_a"] > out["auc_b"] and 0 <= out["p_value"] <= 1 and out["boot_ci_low"] <= out["diff"] <= out["boot_ci_high"]
    assert out["differs_by_test"] == (out["p_value"] < 0.05)
    assert spark.read.parquet(f"{root}/comparisons/elastic_net_one_two").count() == 30
    bins = spark.read.parquet(f"{root}/comparisons/elastic_net_one_two_histogram")
    assert bins.agg(F.sum("n")).first()[0] == 30


def test_draws_go_on_until_enough_hold_both_classes(spark):
    rare = spark.createDataFrame([(str(i), int(i == 0)) for i in range(30)], "id string, y int")
    got = resample.bootstraps(rare, 12, 3)
    assert got.select("b").distinct().count() == 12
    assert got.groupBy("b").agg(F.countDistinct("y").alias("k")).where("k < 2").count() == 0
    with pytest.raises(ValueError):
        resample.bootstraps(rare.where("y = 0"), 3, 3)


def test_catalog_and_config(spark, tmp_path):
    catalog = sheets.artifacts(spark, [("r", "shap", "m", "p1"), ("r", "shap", "n", "p2"), ("r", "shap", "n", "p3")])
    assert sheets.artifact_path(catalog, "r", "shap", "m") == "p1"
    for kind in ("n", "none"):
        with pytest.raises(FileNotFoundError):
            sheets.artifact_path(catalog, "r", "shap", kind)
    path = sinks.write_config(spark, study.Config(), f"file://{tmp_path}", "r", n_ids=3)
    text = json.loads(spark.read.text(path).first()[0])
    assert (text["n_ids"], text["run"], text["n_outer"]) == (3, "r", 5)


def test_correlations_by_group_and_of_a_constant(spark):
    rows = [(g, str(i), f, v) for g in ("a", "b") for i in range(12) for f, v in (("x", float(i % 5)), ("y", float(i * (1 if g == "a" else -1))), ("z", 1.0))]
    got = {(r["g"], r["i"], r["j"]): r["rho"] for r in reduction.correlations(spark.createDataFrame(rows, "g string, id string, feature string, value double"), by=("g",)).collect()}
    assert got["a", "x", "y"] == pytest.approx(-got["b", "x", "y"]) and got["a", "x", "z"] is None
