"""Connected components of an edge table, without collecting it.

Each round contracts, then stars. Contracting: tasks of at most some ``PER_TASK`` edges, dealt
without a shuffle, put a forest over their edges in their place, as an edge from each vertex to
the smallest of its tree. Where one task holds all edges that are left, that is the answer;
otherwise large and small star steps (Kiveris et al., 2014) join the trees of the tasks: each
vertex's smallest neighbour is an aggregate, so hubs are pre-aggregated before the shuffle, and
the edges of a hub meet that neighbour in several tasks. Each round is written to the shared
folder, which cuts the lineage. The number of tasks grows with the edges, the memory of a task
doesn't.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, handing_back, spread_join, written

#: Edges contracted in one task, and vertices of the forest a task has at hand (some 100 bytes each).
PER_TASK = 250_000


class _Forest:
    """Trees of vertices, each named by its smallest."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, i: int) -> int:
        up = self.up
        while (j := up.setdefault(i, i)) != i:
            up[i] = up[j]
            i = j
        return i

    def link(self, edges: Iterable[tuple[int, int]]) -> None:
        for a, b in edges:
            a, b = self.root(int(a)), self.root(int(b))
            if a != b:
                self.up[max(a, b)] = min(a, b)

    def stars(self, roots: bool = False) -> pd.DataFrame:
        """(a, b) of each vertex and its tree's smallest, also of that itself with ``roots``."""
        rows = [(i, r) for i in list(self.up) if (r := self.root(i)) != i or roots]
        return pd.DataFrame(rows, columns=["a", "b"], dtype="int64")


def stars(edges: Iterable[tuple[int, int]]) -> pd.DataFrame:
    """The same components with an edge from each vertex to its smallest: chains would cost rounds."""
    forest = _Forest()
    forest.link(edges)
    return forest.stars()


def _contracted(edges: DataFrame, tasks: int) -> DataFrame:
    """Stars of the trees of ``tasks`` tasks' edges; of one task's edges with their roots."""
    most, roots = 4 * PER_TASK, tasks == 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forest = _Forest()
        for batch in batches:
            forest.link(zip(batch["a"].tolist(), batch["b"].tolist()))
            if len(forest.up) > most and not roots:  # files may be uneven: hand on and begin anew
                yield forest.stars()
                forest = _Forest()
        yield forest.stars(roots)

    return edges.coalesce(tasks).mapInPandas(handing_back(run), "a bigint, b bigint")


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(edges: DataFrame, large: bool, n: int) -> DataFrame:
    """``n`` edges or fewer: link each vertex's neighbours (larger ones, or smaller ones and itself) to its smallest."""
    around = _both_ways(edges) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    nearest = around.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    least = nearest.select("a", F.least("a", "m").alias("m"))
    out = spread_join(around, least, "a", nearest.select("a", "n"), n, ["b"])
    if large:
        out = out.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = out.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(vertex, component): component is the smallest vertex reachable. Vertices without an
    edge don't appear; null ends are ignored; loops and repeated edges do no harm."""
    spark = edges.sparkSession
    now = written(edges.where("a is not null and b is not null and a <> b").select("a", "b"), "edges")
    seen = None
    for _ in range(rounds):
        tasks = max(1, math.ceil(now.count() / PER_TASK))
        then = written(_contracted(now, tasks), "edges")
        forget(spark, now)
        n = then.count()
        if tasks == 1:
            return then.select(F.col("a").alias("vertex"), F.col("b").alias("component"))
        now = written(_star(_star(then, True, n), False, n), "edges")
        forget(spark, then)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("b").alias("vertex"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("vertex"), F.col("b").alias("component")).union(roots)
