"""Folds, bootstraps and permutations by MD5 of seed and id: equal on every engine and run."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ranking import numbered


def _md5(*parts: Column | str | int) -> Column:
    return F.md5(F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]))


def hash_order(ids: Sequence[str], *parts: str | int) -> np.ndarray:
    """Places of ``ids`` in the order of the hashes of ``parts`` and id that ``_md5`` makes, for a task that holds all ids."""
    start = hashlib.md5(":".join(map(str, [*parts, ""])).encode())
    digests = bytearray()
    for i in ids:
        own = start.copy()
        own.update(i.encode())
        digests += own.digest()
    halves = np.frombuffer(bytes(digests), ">u8").reshape(-1, 2)
    return np.lexsort((halves[:, 1], halves[:, 0]))


def draw(n: Column, *parts: Column | str | int) -> Column:
    """A number from 0 to n - 1 from a hash of ``parts``."""
    return F.pmod(F.conv(F.substring(_md5(*parts), 1, 12), 16, 10).cast("bigint"), n)


def stratified_folds(labels: DataFrame, k: int, seed: int, within: tuple[str, ...] = (), out: str = "fold") -> DataFrame:
    """Deal the rows of each class round-robin in hash order; classes differ by one at most."""
    rows = labels.withColumn("_h", _md5(seed, F.col("id")))
    if within:
        order = Window.partitionBy(*within).orderBy("y", "_h")
        return rows.withColumn(out, ((F.row_number().over(order) - 1) % k).cast("int")).drop("_h")
    return numbered(rows, ["y"], "_h", "_n").withColumn(out, (F.col("_n") % k).cast("int")).drop("_n", "_h")


def inner_folds(folds: DataFrame, k: int, seed: int, n_outer: int) -> DataFrame:
    """Folds of each outer fold's training rows."""
    outer = folds.withColumn("outer", F.explode(F.sequence(F.lit(0), F.lit(n_outer - 1)))).where("outer <> fold")
    return stratified_folds(outer, k, seed, ("outer",), "inner").select("outer", "id", "y", "inner")


#: Rows that are sent whole to each task that draws from them.
MOST_SENT = 1_000_000
#: Draws counted in one task, if one resample isn't more.
DRAWS_EACH = 250_000


def positions(rows: DataFrame) -> DataFrame:
    """``rows`` with pos, their places from 0 in hash order."""
    return numbered(rows.withColumn("_h", _md5("row", F.col("id"))), [], "_h", "pos").drop("_h")


def draws(spark: SparkSession, rows: DataFrame, n: int, which: Sequence[int], seed: int, attempt: int = 0) -> DataFrame:
    """b, times and the columns of ``rows`` (n of them, with pos): n drawn with replacement for each b
    of ``which``. A resample is drawn and counted in one task, so that no single draw is shuffled; larger
    ones are dealt to more tasks, by range, so that a task's counts don't grow with all resamples."""
    tasks = max(4 * spark.sparkContext.defaultParallelism, -(-len(which) * n // DRAWS_EACH))  # tiny rows with much work each
    which = spark.createDataFrame([(int(b),) for b in which], "b int").repartitionByRange(max(1, min(len(which), tasks)), "b")
    key = [seed, F.col("b"), *([attempt] if attempt else []), F.col("j")]
    every = which.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    drawn = every.select("b", draw(F.lit(n), *key).alias("pos")).groupBy("b", "pos").agg(F.count("*").alias("times"))
    return drawn.join(F.broadcast(rows) if n <= MOST_SENT else rows, "pos").drop("pos")


def bootstrap_counts(labels: DataFrame, n_boot: int, seed: int) -> DataFrame:
    """(b, id, y, times): rows drawn with replacement, as many as there are."""
    rows = positions(labels.select("id", "y"))
    return draws(labels.sparkSession, rows, labels.count(), range(n_boot), seed).select("b", "id", "y", "times")


def usable_bootstraps(drawn: DataFrame, n_boot: int) -> DataFrame:
    """The first ``n_boot`` draws that hold both classes."""
    both = drawn.groupBy("b").agg(F.min("y").alias("lo"), F.max("y").alias("hi")).where("lo < hi")
    first = both.withColumn("r", F.row_number().over(Window.orderBy("b"))).where(F.col("r") <= n_boot)
    return drawn.join(first.select("b"), "b", "left_semi")


def bootstraps(labels: DataFrame, n_boot: int, seed: int) -> DataFrame:
    """``n_boot`` draws that hold both classes: one that doesn't is drawn again, with its attempt in the hash."""
    if labels.select("y").distinct().count() < 2:
        raise ValueError("a bootstrap of one class never holds both")
    rows, n = positions(labels.select("id", "y")), labels.count()
    wanted, attempt, out = list(range(n_boot)), 0, None
    while wanted:
        drawn = draws(labels.sparkSession, rows, n, wanted, seed, attempt)
        one = drawn.groupBy("b").agg(F.min("y").alias("lo"), F.max("y").alias("hi")).where("lo = hi")
        again = sorted(r["b"] for r in one.select("b").collect())  # at most n_boot numbers
        kept = drawn.where(~F.col("b").isin(again)) if again else drawn
        out = kept if out is None else out.unionByName(kept)
        wanted, attempt = again, attempt + 1
    return out.select("b", "id", "y", "times")


def permuted_labels(labels: DataFrame, n_perm: int, seed: int) -> DataFrame:
    """(perm, id, y): labels dealt in one hash order to ids in another."""
    rows = labels.withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(n_perm - 1))))
    at = lambda side: F.row_number().over(Window.partitionBy("perm").orderBy(_md5(seed, side, F.col("perm"), F.col("id"))))
    ids = rows.select("perm", "id", at("id").alias("r"))
    ys = rows.select("perm", "y", at("y").alias("r"))
    return ids.join(ys, ["perm", "r"]).select("perm", "id", "y")


def permuted_in_task(ids: Sequence[str], y: np.ndarray, perm: int, seed: int) -> np.ndarray:
    """The labels of ``permuted_labels``, in the order of ``ids``."""
    out = np.empty_like(y)
    out[hash_order(ids, seed, "id", perm)] = y[hash_order(ids, seed, "y", perm)]
    return out


def folds_in_task(order: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
    """The folds of ``stratified_folds`` from the order of the ids' hashes."""
    fold = np.empty(len(y), np.int16)
    fold[order[np.argsort(y[order], kind="stable")]] = np.arange(len(y)) % k
    return fold
