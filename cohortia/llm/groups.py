"""Telling rows what is known of their group, whatever the group's size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Groups that every task may know.
HEAVY = 4096


def with_group(rows: DataFrame, groups: DataFrame, keys: list[str], total: int) -> DataFrame:
    """``rows``, of which there are ``total``, with the columns of their group in ``groups``
    (keys..., n, ...; n: its rows), null for groups of one row; keys aren't null.

    Groups of a ``HEAVY``-th of all rows or more, which are ``HEAVY`` at most, are broadcast; the
    others meet their rows in a join where no key has more rows than that."""
    least = max(2, -(-total // HEAVY))
    more = [c for c in groups.columns if c not in keys]
    found = rows.join(F.broadcast(groups.where(F.col("n") >= least)), keys, "left")
    if least == 2:
        return found
    few = groups.where(F.col("n").between(2, least - 1))
    return found.where("n is not null").unionByName(found.where("n is null").drop(*more).join(few, keys, "left"))
