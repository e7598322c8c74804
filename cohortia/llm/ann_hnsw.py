"""Nearest neighbours by hierarchical navigable small-world graphs, one for each shard.

Equal vectors are one node that knows its smallest ids, so a very common vector is one node and
loses no tie. Nodes are dealt to shards of about ``SHARD`` by the range of their norm and by
hash. A shard's graph, whatever its size, is built by inserting nodes: each searches the graph so
far from its top level down and is linked, in each of its levels, with the nearest found that lie
in different directions, and back. Nodes are inserted in batches, no larger than the graph so
far, whose members also see each other. The largest inner product is made a nearest distance by
one more coordinate that gives all vectors one length. A graph is stored as flat arrays: the
vectors, and for each level its nodes and their neighbours. Queries come in blocks; each block
meets each shard once, and the shards' best are merged by score.

Cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do
those whose length isn't the most common one; repeated rows count once; equal vectors are
ordered by vec_id; with fewer candidates than asked for all are returned; an empty table
gives no rows; null ids take no part; further columns aren't read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table, written

SHARD, QUERY_BLOCK = 16384, 16384
#: Neighbours chosen (twice as many are kept at level 0), candidates they are chosen from, and the
#: width of the search that finds these; nodes inserted at once.
LINKS, CHOICE, WIDTH, BATCH = 16, 48, 64, 512


def _diverse(x: np.ndarray, near: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates (nearest first, -1 for none) those nearer to it than to any
    chosen before; then the nearest others, up to ``most``."""
    b, c = near.shape
    v = x[np.maximum(near, 0)]
    between = np.matmul(v, v.transpose(0, 2, 1))
    valid = near >= 0
    chosen = np.zeros((b, c), bool)
    closest = np.full((b, c), -np.inf, np.float32)  # to any chosen one
    count = np.zeros(b, np.int64)
    for j in range(c):
        take = valid[:, j] & (sims[:, j] > closest[:, j]) & (count < most)
        chosen[:, j] = take
        count += take
        closest = np.where(take[:, None], np.maximum(closest, between[:, j]), closest)
    rank = np.where(chosen, 0, np.where(valid, 1, 2)) * c + np.arange(c)
    order = np.argsort(rank, axis=1)[:, :most]
    out = np.take_along_axis(near, order, 1)
    return np.where(np.take_along_axis(valid, order, 1), out, -1)


class Graph:
    """One shard's graph: for each level, a row of neighbours for each node (-1: none, or not in the level)."""

    def __init__(self, vectors: np.ndarray, near: list[np.ndarray]):
        self.vectors, self.near = vectors, near
        self.x = self._same_length(vectors)

    @staticmethod
    def _same_length(vectors: np.ndarray) -> np.ndarray:
        v = vectors / max(np.sqrt((vectors**2).sum(axis=1).max()), 1e-300)
        rest = np.sqrt(np.maximum(0, 1 - (v**2).sum(axis=1)))
        return np.concatenate([v, rest[:, None]], axis=1).astype(np.float32)

    @classmethod
    def build(cls, vectors: np.ndarray) -> tuple[Graph, np.ndarray]:
        """The graph and each node's highest level. Node 0 is in all levels: searches begin there."""
        n = len(vectors)
        height = np.minimum((-np.log(1 - np.random.default_rng(n).random(n)) / math.log(LINKS)).astype(int), 6)
        height[0] = height.max()
        graph = cls(vectors, [np.full((n, LINKS if level else 2 * LINKS), -1, np.int32) for level in range(height[0] + 1)])
        a = 1
        while a < n:
            b = min(n, a + min(a, BATCH))
            graph._insert(np.arange(a, b), height[a:b])
            a = b
        return graph, height

    def _insert(self, ids: np.ndarray, height: np.ndarray) -> None:
        q = self.x[ids]
        at = np.zeros(len(ids), np.int64)
        best = q @ self.x[0]
        for level in range(len(self.near) - 1, -1, -1):
            passes, joins = np.flatnonzero(height < level), np.flatnonzero(height >= level)
            if len(passes):
                at[passes], best[passes] = self._walk(q[passes], at[passes], best[passes], level)
            if len(joins):
                found, sims = self._beam(q[joins], at[joins], best[joins], WIDTH, level)
                at[joins], best[joins] = found[:, 0], sims[:, 0]
                self._link(level, ids[joins], found, sims)

    def _link(self, level: int, ids: np.ndarray, found: np.ndarray, sims: np.ndarray) -> None:
        x, near, m = self.x, self.near[level], len(ids)
        own = x[ids] @ x[ids].T  # of a batch, each node sees those before it
        own[np.arange(m)[None, :] >= np.arange(m)[:, None]] = -np.inf
        first = np.argsort(-own, axis=1, kind="stable")[:, : CHOICE // 2]
        ids_, sims_ = np.concatenate([found, ids[first]], axis=1), np.concatenate([sims, np.take_along_axis(own, first, 1)], axis=1)
        chosen = self._chosen(ids_, sims_, LINKS)
        near[ids, : chosen.shape[1]] = chosen
        # and back: the new ones beside those a node has; where they are too many, it chooses anew
        one, two = chosen.ravel(), np.repeat(ids, chosen.shape[1])
        one, two = one[chosen.ravel() >= 0], two[chosen.ravel() >= 0]
        order = np.lexsort((-np.einsum("nd,nd->n", x[one], x[two]), one))
        one, two = one[order], two[order]
        nodes, begin, count = np.unique(one, return_index=True, return_counts=True)
        rank = np.arange(len(one)) - np.repeat(begin, count)
        have = (near[nodes] >= 0).sum(axis=1)
        fits = np.repeat(have + count <= near.shape[1], count)
        near[one[fits], (np.repeat(have, count) + rank)[fits]] = two[fits]
        over = have + count > near.shape[1]
        if over.any():
            row = np.repeat(np.cumsum(over) - 1, count)
            new = np.full((int(over.sum()), min(int(count[over].max()), CHOICE)), -1, np.int64)
            some = ~fits & (rank < new.shape[1])
            new[row[some], rank[some]] = two[some]
            nodes = nodes[over]
            for a in range(0, len(nodes), 512):
                all_ = np.concatenate([near[nodes[a : a + 512]], new[a : a + 512]], axis=1)
                s = np.matmul(x[np.maximum(all_, 0)], x[nodes[a : a + 512], :, None])[:, :, 0]
                near[nodes[a : a + 512]] = self._chosen(all_, np.where(all_ >= 0, s, -np.inf), near.shape[1])

    def _chosen(self, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        order = np.argsort(-sims, axis=1, kind="stable")[:, : max(CHOICE, most)]
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        return np.concatenate([_diverse(self.x, np.where(np.isfinite(s), i, -1), s, most) for i, s in zip(np.array_split(ids, -(-len(ids) // 512)), np.array_split(sims, -(-len(ids) // 512)))])

    def search(self, queries: np.ndarray, k: int, ef: int) -> np.ndarray:
        """Up to max(k, ef) nearest nodes of each query, -1 for none, nearest first."""
        norm = np.sqrt((queries**2).sum(axis=1, keepdims=True))
        q = np.concatenate([queries / np.maximum(norm, 1e-300), np.zeros((len(queries), 1))], axis=1).astype(np.float32)
        at = np.zeros(len(q), np.int64)
        best = q @ self.x[0]
        for level in range(len(self.near) - 1, 0, -1):
            at, best = self._walk(q, at, best, level)
        return self._beam(q, at, best, max(k, ef), 0)[0]

    def _walk(self, q: np.ndarray, at: np.ndarray, best: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """From each query's place to the nearest neighbour, while there is a nearer one."""
        at, best, near = at.copy(), best.copy(), self.near[level]
        todo = np.arange(len(q))
        while len(todo):
            to = near[at[todo]]
            ids = np.where(to >= 0, to, at[todo][:, None])
            s = np.matmul(self.x[ids], q[todo][:, :, None])[:, :, 0]
            j = s.argmax(axis=1)
            better = s[np.arange(len(todo)), j] > best[todo]
            moved = todo[better]
            best[moved] = s[better, j[better]]
            at[moved] = ids[better, j[better]]
            todo = moved
        return at, best

    def _beam(self, q: np.ndarray, at: np.ndarray, best: np.ndarray, ef: int, level: int, step: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """The ``ef`` nearest nodes met (-1: none) and their similarities; ``step`` nodes are opened at once."""
        m, near = len(q), self.near[level]
        ids = np.full((m, ef), -1, np.int64)
        sims = np.full((m, ef), -np.inf, np.float32)
        done = np.ones((m, ef), bool)
        ids[:, 0], sims[:, 0], done[:, 0] = at, best, False
        seen = np.zeros((m, len(self.x)), bool)
        seen[np.arange(m), at] = True
        todo = np.arange(m)
        while len(todo):
            # rows are sorted by similarity: the first open ones are the nearest
            place = np.cumsum(~done[todo], axis=1)
            rows, cols = np.nonzero(~done[todo] & (place <= step))
            done[todo[rows], cols] = True
            source = np.full((len(todo), step), -1, np.int64)
            source[rows, place[rows, cols] - 1] = ids[todo[rows], cols]
            to = np.where(source[:, :, None] >= 0, near[np.maximum(source, 0)], -1).reshape(len(todo), -1).astype(np.int64)
            to.sort(axis=1)
            fresh = (to >= 0) & ~seen[todo[:, None], np.maximum(to, 0)]
            fresh[:, 1:] &= to[:, 1:] != to[:, :-1]
            rows, cols = np.nonzero(fresh)
            got = to[rows, cols]
            seen[todo[rows], got] = True
            s = np.full(to.shape, -np.inf, np.float32)
            s[rows, cols] = np.einsum("nd,nd->n", self.x[got], q[todo[rows]])
            all_s = np.concatenate([sims[todo], s], axis=1)
            all_i = np.concatenate([ids[todo], np.where(fresh, to, -1)], axis=1)
            all_d = np.concatenate([done[todo], ~fresh], axis=1)
            keep = np.argsort(-all_s, axis=1, kind="stable")[:, :ef]
            sims[todo] = np.take_along_axis(all_s, keep, 1)
            ids[todo] = np.take_along_axis(all_i, keep, 1)
            done[todo] = np.take_along_axis(all_d, keep, 1)
            todo = todo[(~done[todo]).any(axis=1)]
        return ids, sims


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id, v (array<double>) of the vectors that take part."""
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")).where("vec_id is not null and v is not null")
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(F.coalesce(sound, F.lit(False)))
    size = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("v") == (size["d"] if size else 0))


def build_index(vectors: DataFrame, k: int = 20, shard_size: int = SHARD) -> DataFrame:
    """One row for each shard: shard, n, vectors (float64), ids (the k + 1 smallest of each
    node) and each level's nodes and neighbours, as flat arrays."""
    first = Window.partitionBy("v").orderBy("vec_id")
    ranked = vectors.distinct().withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1)
    nodes = written(ranked.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "nodes")
    # one very long vector would leave its shard's others no distances: a shard's norms differ 16-fold at most
    squares = F.aggregate("v", F.lit(0.0), lambda total, x: total + x * x)
    nodes = nodes.withColumn("range", F.coalesce(F.round(F.log(squares) / math.log(256)), F.lit(0.0)).cast("int"))
    parts, before = [], []
    for r in nodes.groupBy("range").count().orderBy("range").collect():  # some 500 ranges at most
        shards = math.ceil(r["count"] / shard_size)
        before += [F.lit(r["range"]), F.lit(sum(n for n, _ in parts))]
        parts.append((shards, [F.lit(r["range"]), F.lit(shards)]))
    of = lambda pairs: F.create_map(*pairs)[F.col("range")] if pairs else F.lit(1)
    shard = of(before) + F.pmod(F.xxhash64("v"), of([x for _, pair in parts for x in pair]))

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(rows["v"].to_numpy()).astype(np.float64)
        order = np.lexsort(x.T[::-1])  # the same graph however the rows arrive
        order = order[np.random.default_rng(len(x)).permutation(len(x))]
        x, ids = x[order], [rows["ids"].iloc[i] for i in order]
        graph, height = Graph.build(x)
        nodes = [np.flatnonzero(height >= level).astype(np.int32) for level in range(len(graph.near))]
        return pd.DataFrame(
            {
                "shard": [rows["shard"].iloc[0]],
                "n": [len(x)],
                "vectors": [x.tobytes()],
                "id_counts": [np.array([len(i) for i in ids], np.int32).tobytes()],
                "ids": [np.concatenate(ids).astype(np.int64).tobytes()],
                "nodes": [[a.tobytes() for a in nodes]],
                "links": [[near[a].tobytes() for near, a in zip(graph.near, nodes)]],
            }
        )

    dealt = nodes.withColumn("shard", shard.cast("int")).drop("range")
    return written(
        dealt.groupBy("shard").applyInPandas(build, "shard int, n bigint, vectors binary, id_counts binary, ids binary, nodes array<binary>, links array<binary>"), "index"
    )


def nearest(index: DataFrame, queries: DataFrame, k: int = 20, ef: int = 160, block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: ``queries`` has vec_id and v; own ids aren't returned."""
    queries = queries.distinct()
    blocks = max(1, math.ceil(queries.count() / block))
    shards = [r["shard"] for r in index.select("shard").toLocalIterator()]  # one number a shard
    asked = queries.select(F.col("vec_id").alias("query_id"), "v", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"))
    asked = asked.withColumn("shard", F.explode(F.lit(shards) if shards else F.array().cast("array<int>")))
    held = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def search(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        columns = ["query_id", "vec_id", "score"]
        if not len(own) or not len(asked):
            return pd.DataFrame(columns=columns)
        r = own.iloc[0]
        vectors = np.frombuffer(r["vectors"], np.float64).reshape(r["n"], -1)
        near = []
        for a, b in zip(r["nodes"], r["links"]):
            nodes = np.frombuffer(a, np.int32)
            links = np.frombuffer(b, np.int32).reshape(len(nodes), -1)
            near.append(np.full((r["n"], links.shape[1]), -1, np.int32))
            near[-1][nodes] = links
        graph = Graph(vectors, near)
        counts = np.frombuffer(r["id_counts"], np.int32)
        ids = np.frombuffer(r["ids"], np.int64)
        begin = np.cumsum(counts) - counts
        out = []
        for a in range(0, len(asked), 256):
            part = asked.iloc[a : a + 256]
            q = np.stack(part["v"].to_numpy()).astype(np.float64)
            found = graph.search(q, k + 1, ef)[:, : 2 * k + 2]
            for i, query in enumerate(part["query_id"].to_numpy()):
                node = found[i][found[i] >= 0]
                score = np.repeat(vectors[node] @ q[i], counts[node])
                vec = np.concatenate([ids[begin[j] : begin[j] + counts[j]] for j in node]) if len(node) else np.empty(0, np.int64)
                other = vec != query
                vec, score = vec[other], score[other]
                best = np.lexsort((vec, -score))[:k]
                out.append(pd.DataFrame({"query_id": query, "vec_id": vec[best], "score": score[best]}))
        return pd.concat(out)[columns]

    each = held.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInPandas(search, "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search_all(vectors: DataFrame, every: int = 20, k: int = 20, ef: int = 160, shard_size: int = SHARD, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The nearest of every row whose id is divisible by ``every``, against all rows."""
    rows = written(usable(vectors, id_col, vec_col).withColumn("vec_id", F.col("vec_id").cast("bigint")), "vectors")
    return nearest(build_index(rows, k, shard_size), rows.where(F.col("vec_id") % every == 0), k, ef)


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_all(table(spark, sf_dir, "embeddings"))
