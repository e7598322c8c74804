"""Session settings and what Python workers need to find this package."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def workers_find_us(spark: SparkSession) -> SparkSession:
    """Let Python workers started from now on import this package from where the driver has
    it (on a cluster, where that folder is another, use ``--py-files`` or install it)."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    return spark


def local_session(cpus: int = 8, **conf: str) -> SparkSession:
    """For tests and the benchmark; a cluster brings its own session."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("cohortia")
    settings = {
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.sql.adaptive.enabled": "true",
    }
    for k, v in (settings | conf).items():
        builder = builder.config(k, v)
    return workers_find_us(builder.getOrCreate())
