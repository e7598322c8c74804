"""Ranks with ties, prefix sums, quantiles and row numbers; those of whole tables need no single task."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import cut_lineage


def midrank(by: list[str], value: str) -> Column:
    """Average rank of ties inside each group of ``by``."""
    ordered = Window.partitionBy(*by).orderBy(value)
    tied = Window.partitionBy(*by, value)
    return F.rank().over(ordered) + (F.count("*").over(tied) - 1) / F.lit(2.0)


def below(df: DataFrame, by: list[str], value: str, sums: list[str], parts: int = 64) -> DataFrame:
    """``df``, which has a value once in each group of ``by``, with ``<c>_below`` for each of ``sums``:
    the sum of c over the group's smaller values.

    Values are dealt into ranges of about equal rows, summed inside each (group, range); prefix
    sums over at most ``parts`` ranges of a group do the rest, so no task sees all rows of a group."""
    cuts = df.agg(F.percentile_approx(value, [i / parts for i in range(1, parts)], 1000).alias("_cuts"))
    rows = df.join(F.broadcast(cuts))  # one row
    rows = rows.withColumn("_b", F.when(F.col(value).isNull(), -1).otherwise(F.size(F.filter("_cuts", lambda c: c < F.col(value))))).drop("_cuts")
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(*by, "_b").agg(*[F.sum(c).alias(f"_{c}") for c in sums])
    starts = starts.select(*by, "_b", *[F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_{c}") for c in sums])
    inside = Window.partitionBy(*by, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({f"{c}_below": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in sums})
    out = rows.alias("l").join(starts.alias("r"), _same([*by, "_b"]))
    return out.select(*[F.col(f"l.{c}") for c in df.columns], *[(F.col(f"l.{c}_below") + F.col(f"r._{c}")).alias(f"{c}_below") for c in sums])


def _same(keys: list[str]) -> Column:
    """Equal keys of frames l and r, where null equals null."""
    return functools.reduce(operator.and_, [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in keys])


def value_ranks(df: DataFrame, by: list[str], value: str, out: str = "rank") -> DataFrame:
    """by..., value, n (rows), ``out`` (average rank) of each distinct value of each group."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias("n"))
    return below(counts, by, value, ["n"]).select(*by, value, "n", (F.col("n_below") + (F.col("n") + 1) / F.lit(2.0)).alias(out))


def with_value(df: DataFrame, values: DataFrame, keys: list[str], n: str, total: int) -> DataFrame:
    """``df``, of ``total`` rows, with the other columns of ``values``, which has one row for each ``keys``
    of it and ``n``, its rows in ``df``. Keys that a thousandth of all rows or more have are a
    thousand at most and broadcast; the others meet in a join none of whose keys has more."""
    more = [c for c in values.columns if c not in keys and c != n]
    heavy = F.col(n) * 1000 >= total
    pick = lambda which: values.where(which).select(*keys, *more, F.lit(True).alias("_met")).alias("r")
    own = [F.col(f"l.{c}").alias(c) for c in df.columns]
    found = df.alias("l").join(F.broadcast(pick(heavy)), _same(keys), "left").select(*own, *more, "_met")
    if total <= 1000:
        return found.drop("_met")
    light = found.where("_met is null").drop("_met", *more).alias("l").join(pick(~heavy), _same(keys)).select(*own, *more, "_met")
    return found.where("_met is not null").unionByName(light).drop("_met")


def with_midrank(df: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """``df`` with average ranks of ties inside each group of ``by``, from the ranks of distinct values."""
    df = cut_lineage(df)
    return with_value(df, value_ranks(df, by, value, out), [*by, value], "n", df.count())


def quantiles(df: DataFrame, by: list[str], value: str, shares: list[float], out: str = "q") -> DataFrame:
    """by..., ``out``: exact quantiles of each group, between neighbours in proportion; nulls don't
    count. They are picked from the running counts of distinct values, so no buffer holds a group."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    totals = counts.groupBy(*by).agg(F.sum("n").alias("_all"))
    rows = below(counts, by, value, ["n"])
    rows = rows.alias("l").join(totals.alias("r"), _same(by)).select("l.*", "_all") if by else rows.join(F.broadcast(totals))  # one row
    ends = []
    for i, q in enumerate(shares):
        place = F.lit(float(q)) * (F.col("_all") - 1)
        holds = lambda r: (F.col("n_below") <= r) & (r < F.col("n_below") + F.col("n"))
        ends += [F.max(F.when(holds(F.floor(place)), F.col(value))).alias(f"_lo{i}"), F.max(F.when(holds(F.ceil(place)), F.col(value))).alias(f"_hi{i}"), F.max(place - F.floor(place)).alias(f"_at{i}")]
    # only values at a wanted place are summed
    wanted = rows.groupBy(*by).agg(*ends)
    return wanted.select(*by, F.array(*[F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_at{i}") for i in range(len(shares))]).alias(out))


def normalized_rank(value: str) -> Column:
    """(midrank - 1) / (n - 1) over the whole frame, 0 where there is one row: for summary
    tables, which have one row a feature."""
    n = F.count("*").over(Window.partitionBy())
    return F.when(n <= 1, F.lit(0.0)).otherwise((midrank([], value) - 1) / (n - 1))


def top_k(df: DataFrame, by: list[str], value: str, k: int | Column, name: str = "feature") -> DataFrame:
    """The k largest of each group; ties go to the smaller name."""
    order = Window.partitionBy(*by).orderBy(F.desc(value), name)
    return df.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r")


def numbered(df: DataFrame, by: list[str], key: str, out: str = "n", digits: int = 2) -> DataFrame:
    """Row numbers from 0 in the order of (by..., key), for a ``key`` of hexadecimal digits.

    Rows are numbered inside the groups of equal ``by`` and first digits; prefix sums over the
    groups' counts make the numbers global, so that no task sees all rows."""
    df = df.withColumn("_b", F.substring(key, 1, digits))
    groups = df.groupBy(*by, "_b").count()
    before = Window.orderBy(*by, "_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = groups.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("_b").alias("_g"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_s"))
    same = F.col("_b") == F.col("_g")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    inside = Window.partitionBy(*by, "_b").orderBy(key)
    return (
        df.withColumn("_r", F.row_number().over(inside) - 1)
        .join(starts, same)
        .withColumn(out, F.col("_r") + F.col("_s"))
        .drop("_b", "_g", "_r", "_s", *[f"_{c}" for c in by])
    )
