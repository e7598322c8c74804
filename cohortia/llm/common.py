"""Table access and shared-folder helpers for the corpus operators."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import workers_find_us

#: A-Z only: other letters keep their case, unlike with ``lower()``.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return workers_find_us(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def whole_text(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in ``spark.checkpoint.dir``; where
    that is unset, a folder of our own if all runs on this machine, else an error."""
    set_to = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if set_to:
        return set_to.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = os.environ.get("COHORTIA_SHARED") or tempfile.mkdtemp(prefix="cohortia-")
    os.environ["COHORTIA_SHARED"] = own
    return f"file://{own}"


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it back.

    The commit is atomic by task, so a lost executor costs only its running tasks, and
    whatever follows sees one fixed version of the rows."""
    path = fresh_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete tables made by ``written`` that are no longer read."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for df in frames:
        for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            at = jvm.org.apache.hadoop.fs.Path(parent)
            at.getFileSystem(conf).delete(at, True)


#: A key of more rows than ``LEAST`` and than 1 / ``HOT`` of them all is spread over tasks.
HOT, LEAST = 10_000, 100_000


def spread_join(rows: DataFrame, few: DataFrame, key: str, counts: DataFrame, total: int, by: list[str]) -> DataFrame:
    """``rows`` joined with ``few`` by ``key``; a key of very many of ``rows`` is spread over several
    tasks by the columns ``by``, each with all rows of ``few`` for that key. ``counts`` has the rows of
    each key as ``n``, ``total`` is the sum of ``n`` or near it. What is broadcast are the keys to
    spread as pairs of numbers: by the share they must hold, ``HOT`` times (rows / total) at most."""
    most = max(LEAST, total // HOT)
    hot = counts.where(F.col("n") > most).groupBy(F.xxhash64(key).alias("_h"))
    hot = F.broadcast(hot.agg(F.max(F.ceil(F.col("n") / most).cast("int")).alias("_parts")))
    parts = F.coalesce("_parts", F.lit(1))
    left = rows.withColumn("_h", F.xxhash64(key)).join(hot, "_h", "left").withColumn("_part", F.pmod(F.xxhash64(*by), parts).cast("int"))
    right = few.withColumn("_h", F.xxhash64(key)).join(hot, "_h", "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
    return left.drop("_h", "_parts").join(right.drop("_h", "_parts"), [key, "_part"]).drop("_part")


#: What a worker keeps from one task of an operator to the next.
KEPT: dict = {}


def _drop_kept() -> None:
    KEPT.clear()


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def handing_back(run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], keeps: bool = False) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """``run`` of a mapInPandas, whose worker gives freed memory back to the system after each
    batch and at the end: workers are used again and would keep the peak of every stage. What an
    earlier operator kept in the worker is dropped, unless this one ``keeps`` it."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch
            _give_back()

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if not keeps:
            _drop_kept()
        yield from run(each(batches))
        _give_back()

    return whole
