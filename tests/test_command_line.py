"""From sheets to consensus by the command line, and the catalog of runs."""

import numpy as np
import pytest

from cohortia.plans import study
from cohortia.sources import sinks


def sheets(path, n=36):
    r = np.random.default_rng(1)
    ids, y = [f"Pz {i:03d}" for i in range(n)], [i % 2 for i in range(n)]
    write = lambda name, rows: (path / name).write_text("\n".join(",".join(f'"{c}"' for c in row) for row in rows) + "\n")
    write("meta.csv", [["attribute", *[f"c{i}" for i in range(n)]], [" key ", *ids], [" kind ", *["ADK" if v else "SCC" for v in y]], ["lab", *["xy"[i % 3 > 0] for i in range(n)]]])
    write("rad.csv", [["id", "f1", "f2", "shape_f3"], *[[pz, f"{v + 0.3 * r.normal():.3f}".replace(".", ","), f"{r.normal():.3f}", str(i * i)] for i, (pz, v) in enumerate(zip(ids, y))]])
    write("gen.csv", [["gene", *ids, "e1", "e2"], *[[g, *[f"{s * v + r.normal():.3f}" for v in y], "0", "0"] for g, s in (("g1", 1), ("g2", 0))]])
    at = [f"--metadata=file://{path}/meta.csv", f"--imaging=file://{path}/rad.csv", f"--genes=file://{path}/gen.csv"]
    return [*at, "--key=key", "--label=kind", "--batch=lab", "--models", "elastic_net"]


def test_from_sheets_to_consensus(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(study.multiverse, "GRID", study.multiverse.GRID | {"gene_selection_method": ("variance",), "redundancy_corr_threshold": (0.9,)})
    root, given = f"file://{tmp_path}/out", sheets(tmp_path)
    for source in ("imaging", "both"):
        study.main(["run", f"--root={root}", f"--run={source}", f"--source={source}", *given])
    study.main(["diagnose", f"--root={root}", "--run=both", *given])
    assert spark.read.parquet(f"{root}/both/permutation_summary").first()["p_value"] < 0.05
    study.main(["spec-curve", f"--root={root}", *given])
    curve = spark.read.parquet(f"{root}/spec_curve/curve")
    assert curve.groupBy("model_type").count().count() == 2 and curve.count() == 2 * 5  # imaging and both with two shapes, genes
    study.main(["consensus", f"--root={root}", "--run=both"])
    found = spark.read.parquet(f"{root}/both/consensus").orderBy("consensus_score").toPandas()
    assert found["feature"].iloc[-1] == "rad__f1" and found["n_criteria_present"].max() == 3
    study.main(["compare", f"--root={root}", "--source-a=imaging", "--source-b=both", "--n-boot=50"])
    assert spark.read.parquet(f"{root}/comparisons/elastic_net_imaging_both_summary").first()["auc_b"] > 0.7
    kinds = {r["kind"] for r in sinks.catalog(spark, root).where("run = 'both'").collect()}
    assert {"features", "reduced", "predictions", "params", "comparison", "pooled", "stability", "stable", "shap", "shap_importance", "config", "whole"} <= kinds


def test_consumers_find_the_last_whole_attempt(spark, tmp_path):
    root = f"file://{tmp_path}"
    assert sinks.whole_table(spark, root, "r", "pooled") == f"{root}/r/pooled"  # never catalogued
    first = sinks.Manifest(spark, root, "r")
    first.commit("pooled", "one")
    with pytest.raises(FileNotFoundError):
        sinks.whole_table(spark, root, "r", "pooled")
    first.close()
    sinks.Manifest(spark, root, "r").commit("pooled", "half")
    assert sinks.whole_table(spark, root, "r", "pooled") == "one"
    with pytest.raises(FileNotFoundError):
        sinks.whole_table(spark, root, "r", "shap")
    last = sinks.Manifest(spark, root, "r")
    last.commit("pooled", "two")
    last.close()
    assert sinks.whole_table(spark, root, "r", "pooled") == "two"
    assert sinks.whole_table(spark, root, "other", "pooled") == f"{root}/other/pooled"
