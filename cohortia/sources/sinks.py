"""Writers of result tables under ``<root>/<run>/<kind>``."""

from __future__ import annotations

import dataclasses
import json
import os
import re
import tempfile
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the folder all executors share, and read again: what follows reads
    fixed rows, and a lost executor costs its running tasks only. ``spark.checkpoint.dir`` names the
    folder; where that is unset, it is one of our own if all runs on this machine, else an error."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        own = os.environ.get("COHORTIA_SHARED") or tempfile.mkdtemp(prefix="cohortia-")
        os.environ["COHORTIA_SHARED"] = own
        folder = f"file://{own}"
    path = f"{folder.rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_table(df: DataFrame, root: str, run: str, kind: str, by: tuple[str, ...] = (), format: str = "parquet") -> str:
    path = f"{root}/{run}/{kind}"
    writer = df.write.mode("overwrite")
    if by:
        writer = writer.partitionBy(*by)
    writer.option("header", "true").csv(path) if format == "csv" else writer.parquet(path)
    return path


def write_config(spark: SparkSession, config: object, root: str, run: str, **found: object) -> str:
    """The whole configuration, and what was found with it (rows, features), as one JSON row."""
    text = json.dumps(dataclasses.asdict(config) | {"run": run} | found, sort_keys=True, default=list)
    path = f"{root}/{run}/config"
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return path


#: The catalog's rows: one for each table, committed after it, and one of kind ``whole`` after a run's last.
CATALOG = "run string, attempt string, at timestamp, kind string, model string, path string"


class Manifest:
    """The catalog of ``root`` as one attempt at a run writes it."""

    def __init__(self, spark: SparkSession, root: str, run: str):
        self.spark, self.root, self.run, self.attempt = spark, root, run, uuid.uuid4().hex

    def commit(self, kind: str, path: str, model: str = "") -> str:
        row = self.spark.createDataFrame([(self.run, self.attempt, datetime.now(timezone.utc), kind, model, path)], CATALOG)
        row.coalesce(1).write.mode("append").parquet(f"{self.root}/_catalog")
        return path

    def write(self, df: DataFrame, kind: str, *by: str, model: str = "") -> str:
        return self.commit(kind, write_table(df, self.root, self.run, kind, by), model)

    def close(self) -> None:
        self.commit("whole", f"{self.root}/{self.run}")


def catalog(spark: SparkSession, root: str) -> DataFrame | None:
    """The catalog's rows; None where no run has committed one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/_catalog")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema(CATALOG).parquet(f"{root}/_catalog")


def whole_table(spark: SparkSession, root: str, run: str, kind: str) -> str:
    """The path of a run's table, as its last whole attempt committed it; a run that was never
    catalogued has its tables at their usual places."""
    rows = catalog(spark, root)
    own = rows.where(F.col("run") == run) if rows is not None else None
    if own is None or not own.take(1):
        return f"{root}/{run}/{kind}"
    last = own.where("kind = 'whole'").orderBy(F.desc("at")).first()
    if last is None:
        raise FileNotFoundError(f"no attempt at run {run} in {root} is whole")
    found = own.where((F.col("attempt") == last["attempt"]) & (F.col("kind") == kind)).first()
    if found is None:
        raise FileNotFoundError(f"run {run} in {root} has no table {kind}")
    return found["path"]
