"""Feature reduction that never looks at labels."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranking import quantiles, top_k, with_midrank
from ..functions.scalars import is_shape
from ..sources.sinks import cut_lineage


def zscores(long: DataFrame) -> DataFrame:
    """Population z-scores of each feature; null where a feature is constant."""
    stats = long.groupBy("feature").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    return long.join(stats, "feature").withColumn("z", (F.col("value") - F.col("m")) / F.nullif(F.col("s"), F.lit(0.0))).drop("m", "s")


def variance_filter(long: DataFrame, threshold: float = 0.01) -> DataFrame:
    """(feature, sd) of features whose variance after scaling is over the threshold. Scaled
    variance is 1, or missing for constants: under 1 the threshold only drops constants."""
    kept = long.groupBy("feature").agg(F.stddev_pop("value").alias("sd"))
    return kept.where((F.col("sd") > 0) & F.lit(threshold < 1))


def iqr(long: DataFrame) -> DataFrame:
    """(feature, iqr); null for a feature without values."""
    q = quantiles(long, ["feature"], "value", [0.25, 0.75])
    spread = q.select("feature", (F.col("q")[1] - F.col("q")[0]).alias("iqr"))
    return long.select("feature").distinct().join(spread, "feature", "left")


def select_genes(long: DataFrame, method: str = "iqr_top_pct", top_n: int = 50, top_pct: float = 0.05, threshold: float = 1000.0) -> DataFrame:
    """(feature, score) kept by one of: variance, iqr_top_n, iqr_top_pct, iqr_threshold."""
    if method == "variance":
        return variance_filter(long).withColumnRenamed("sd", "score")
    spread = iqr(long).withColumnRenamed("iqr", "score")
    if method == "iqr_threshold":
        return spread.where(F.col("score") > threshold)
    if method == "iqr_top_n":
        return top_k(spread, [], "score", top_n)
    if method == "iqr_top_pct":
        n = F.greatest(F.lit(1), F.floor(F.count("*").over(Window.partitionBy()) * F.lit(top_pct)))
        return top_k(spread.withColumn("_k", n), [], "score", F.col("_k")).drop("_k")
    raise ValueError(f"unknown gene selection {method!r}")


#: Cells of a column tile, values of a column that are worked on whole, and columns of a tile.
TILE_CELLS, WHOLE, COLUMNS = 8_000_000, 4_000_000, 512
#: Values of a column that are worked on whole where chunks of ids give the same, and cells of a chunk.
SHORT, CHUNK_CELLS = 20_000, 1_000_000


def _unit(x: np.ndarray, ranks: bool) -> np.ndarray:
    """Columns centred (their ranks, with ties in the middle) and of length 1; constant ones are missing."""
    x = pd.DataFrame(x).rank().to_numpy() if ranks else x
    x = x - x.mean(axis=0)
    length = np.sqrt((x**2).sum(axis=0))
    # what rounding leaves of a constant is no length
    return x / np.where(length > 1e-12 * np.sqrt(len(x)) * np.maximum(np.abs(x).max(axis=0, initial=0), 1e-300), length, np.nan)


def _tile_correlations(x: np.ndarray, y: np.ndarray, ranks: bool) -> np.ndarray:
    """Correlations of the columns of x with those of y over the rows that both have; a column's
    missing cells are NaN. Columns missing the same cells are worked on together."""
    out = np.full((x.shape[1], y.shape[1]), np.nan)
    masks = []
    for m in (~np.isnan(x), ~np.isnan(y)):
        kinds, of = np.unique(m, axis=1, return_inverse=True)
        masks.append((kinds, of.ravel()))
    (kx, ox), (ky, oy) = masks
    for p in range(kx.shape[1]):
        for q in range(ky.shape[1]):
            rows = kx[:, p] & ky[:, q]
            if rows.sum() > 1:
                i, j = np.flatnonzero(ox == p), np.flatnonzero(oy == q)
                out[np.ix_(i, j)] = _unit(x[np.ix_(rows, i)], ranks).T @ _unit(y[np.ix_(rows, j)], ranks)
    return out


def correlations(long: DataFrame, method: str = "spearman", by: tuple[str, ...] = ()) -> DataFrame:
    """(i, j, rho) for i < j over the ids that have both values, inside each group of ``by``; null where
    one of them is constant.

    Columns are packed, one row each, and dealt into tiles; a task has two tiles of columns and
    multiplies them, so pairs never meet in a join. Beyond ``SHORT`` ids, rows are dealt into
    chunks, too, whose sums are added up (``_chunked``); ranks of columns with missing cells differ from
    pair to pair, so those stay whole up to ``WHOLE`` ids."""
    if method not in ("spearman", "pearson"):
        raise ValueError(f"unknown correlation {method!r}")
    cells = long.where("value is not null").select(*by, "id", "feature", F.col("value").cast("double").alias("value"))
    size = cells.groupBy(*by, "feature").agg(F.count("*").alias("n"))
    most, n_features = size.agg(F.max("n"), F.count("*")).first()
    if most and most > min(SHORT, WHOLE) and (most > WHOLE or method == "pearson" or not _gaps(cells, by).take(1)):
        return _chunked(cells, method, by, max(1, CHUNK_CELLS // min(n_features, 2 * COLUMNS)))
    width = max(1, min(COLUMNS, TILE_CELLS // max(most or 1, 1)))
    packed = _tiles(cells.groupBy(*by, "feature").agg(F.collect_list("id").alias("ids"), F.collect_list("value").alias("values")), by, width, n_features)
    ranks = method == "spearman"
    kinds = ", ".join(f"{c} {packed.schema[c].dataType.simpleString()}" for c in by)

    def products(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("feature")
        places, ids = pd.factorize(np.concatenate(list(rows["ids"])))
        x = np.full((len(ids), len(rows)), np.nan)
        x[places, np.repeat(np.arange(len(rows)), rows["ids"].map(len))] = np.concatenate(list(rows["values"]))
        name, tile = rows["feature"].to_numpy(object), rows["tile"].to_numpy()
        one, two = np.flatnonzero(tile == rows["t"].iloc[0]), np.flatnonzero(tile == rows["s"].iloc[0])
        rho = _tile_correlations(x[:, one], x[:, two], ranks)
        i, j = np.triu_indices(len(one), 1) if rows["t"].iloc[0] == rows["s"].iloc[0] else (g.ravel() for g in np.indices(rho.shape))
        r = rho[i, j]
        return pd.DataFrame({c: rows[c].iloc[0] for c in by} | {"i": name[one][i], "j": name[two][j], "rho": pd.Series(r).astype(object).where(~np.isnan(r), None)})

    return packed.groupBy(*by, "t", "s").applyInPandas(products, ", ".join(filter(None, [kinds, "i string, j string, rho double"])))


def _gaps(cells: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Columns that lack ids of their group."""
    full = cells.groupBy(*by, "feature").agg(F.count("*").alias("n"))
    ids = cells.select(*by, "id").distinct()
    n_ids = ids.groupBy(*by).agg(F.count("*").alias("m")) if by else ids.agg(F.count("*").alias("m"))
    return (full.join(n_ids, list(by)) if by else full.join(F.broadcast(n_ids))).where("n < m")  # one row


def _tiles(columns: DataFrame, by: tuple[str, ...], width: int, n_features: int) -> DataFrame:
    """``columns`` once for each tile that theirs meets (t, s: the pair of tiles, t <= s)."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy("feature")) - 1
    names = columns.select(*by, "feature").withColumn("tile", F.floor(n / width).cast("int"))  # names alone are numbered
    tiles = -(-n_features // width)
    if tiles <= 1:
        return columns.withColumns({"tile": F.lit(0), "t": F.lit(0), "s": F.lit(0)})
    met = columns.join(names, [*by, "feature"]).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    met = met.withColumns({"t": F.least("tile", "other"), "s": F.greatest("tile", "other")}).drop("other")
    last = names.groupBy(*by).agg(F.max("tile").alias("last"))
    met = met.join(last, list(by)) if by else met.join(F.broadcast(last))  # one row
    return met.where("s <= last").drop("last")


def _chunked(cells: DataFrame, method: str, by: tuple[str, ...], rows_each: int = 65_536) -> DataFrame:
    """Correlations of columns too long for one task: sums over chunks of ids, with masks of missing cells."""
    keys = [*by, "feature"]
    ids = cells.select(*by, "id").distinct()
    n_ids = ids.groupBy(*by).agg(F.count("*").alias("m")) if by else ids.agg(F.count("*").alias("m"))
    if method == "spearman":
        if _gaps(cells, by).take(1):
            raise ValueError(f"ranks of columns with missing cells need columns of at most {WHOLE} ids")
        cells = with_midrank(cells, keys, "value", "rank").select(*by, "id", "feature", F.col("rank").alias("value"))
    # centred on the column's mean, so that sums of products lose nothing
    middle = cells.groupBy(*keys).agg(F.avg("value").alias("middle"))
    cells = cells.join(middle, keys).select(*by, "id", "feature", (F.col("value") - F.col("middle")).alias("value"))
    n_chunks = max(1, -(-int(n_ids.agg(F.max("m")).first()[0] or 0) // rows_each))
    cells = cells.withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(n_chunks)).cast("int"))
    n_features = cells.select(*keys).distinct().count()
    packed = cells.groupBy(*keys, "chunk").agg(F.collect_list("id").alias("ids"), F.collect_list("value").alias("values"))
    names = _tiles(cells.select(*keys).distinct(), by, COLUMNS, n_features)
    packed = packed.join(names, keys)
    kinds = ", ".join(f"{c} {packed.schema[c].dataType.simpleString()}" for c in by)
    sums = ("n", "x", "y", "xx", "yy", "xy")

    def products(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("feature")
        places, ids = pd.factorize(np.concatenate(list(rows["ids"])))
        x, m = np.zeros((len(ids), len(rows))), np.zeros((len(ids), len(rows)))
        at = places, np.repeat(np.arange(len(rows)), rows["ids"].map(len))
        x[at], m[at] = np.concatenate(list(rows["values"])), 1.0
        name, tile = rows["feature"].to_numpy(object), rows["tile"].to_numpy()
        one, two = np.flatnonzero(tile == rows["t"].iloc[0]), np.flatnonzero(tile == rows["s"].iloc[0])
        xa, ma, xb, mb = x[:, one], m[:, one], x[:, two], m[:, two]
        grids = (ma.T @ mb, xa.T @ mb, ma.T @ xb, (xa**2).T @ mb, ma.T @ xb**2, xa.T @ xb)
        i, j = np.triu_indices(len(one), 1) if rows["t"].iloc[0] == rows["s"].iloc[0] else (g.ravel() for g in np.indices(grids[0].shape))
        return pd.DataFrame({c: rows[c].iloc[0] for c in by} | {"i": name[one][i], "j": name[two][j]} | {k: g[i, j] for k, g in zip(sums, grids)})

    parts = packed.groupBy(*by, "t", "s", "chunk").applyInPandas(products, ", ".join(filter(None, [kinds, "i string, j string"] + [f"{k} double" for k in sums])))
    c = parts.groupBy(*by, "i", "j").agg(*[F.sum(k).alias(k) for k in sums]).where("n > 0")
    n, sx, sy = F.col("n"), F.col("x"), F.col("y")
    vx, vy = F.col("xx") - sx * sx / n, F.col("yy") - sy * sy / n
    apart = (vx > 1e-12 * F.col("xx")) & (vy > 1e-12 * F.col("yy"))
    return c.select(*by, "i", "j", F.when(apart, (F.col("xy") - sx * sy / n) / F.sqrt(vx * vy)).alias("rho"))


def distances(rho: DataFrame) -> DataFrame:
    return rho.withColumn("distance", 1 - F.abs("rho")).drop("rho")


def average_linkage(d: np.ndarray, cut: float) -> np.ndarray:
    """Cluster numbers (by first member) of average linkage, merged while the mean distance is at most ``cut``."""
    n = len(d)
    d = d.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    size, label, alive = np.ones(n), np.arange(n), np.ones(n, bool)
    for _ in range(n - 1):
        k = int(np.argmin(d))
        i, j = sorted(divmod(k, n))
        if not d[i, j] <= cut:
            break
        row = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i], d[:, i] = row, row
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        alive[j] = False
        label[label == j] = i
    return label


def close_components(pairs: DataFrame, by: list[str]) -> DataFrame:
    """by..., feature, component: the smallest feature reachable over ``pairs`` (by..., i, j), by smallest
    neighbours and pointer jumping; each round's table is cut from its lineage."""
    both = cut_lineage(pairs.select(*by, "i", "j").unionByName(pairs.select(*by, F.col("j").alias("i"), F.col("i").alias("j"))).distinct())
    now = both.groupBy(*by, "i").agg(F.least(F.min("j"), F.first("i")).alias("c"))
    while True:
        near = both.join(now.withColumnRenamed("i", "j"), [*by, "j"]).groupBy(*by, "i").agg(F.min("c").alias("near"))
        least = now.join(near, [*by, "i"]).select(*by, "i", F.least("c", "near").alias("m"), "c")
        jump = least.select(*by, F.col("i").alias("m"), F.col("m").alias("then"))
        then = cut_lineage(least.join(jump, [*by, "m"], "left").select(*by, "i", F.coalesce("then", "m").alias("c"), F.col("c").alias("before")))
        now = then.drop("before")
        if not then.where("c <> before").take(1):
            return now.select(*by, F.col("i").alias("feature"), F.col("c").alias("component"))


def cut_clusters(rho: DataFrame, names: DataFrame, thresholds: Sequence[float], by: str = "reduction_group") -> DataFrame:
    """(by, threshold, feature, cluster) of ``names`` (by, feature) for every threshold, from one linkage
    tree for each component of pairs that are close at the loosest threshold: clusters merge at a
    mean distance within the cut only, so some pair of them is within it, and no cluster leaves
    its component. A task has one component's pairs."""
    loosest, cuts = min(thresholds), sorted(thresholds)
    close = rho.where(F.abs("rho") >= loosest - 1e-12)
    comp = close_components(close, [by])
    inside = rho.join(comp.withColumnsRenamed({"feature": "i", "component": "component"}), [by, "i"])
    inside = inside.join(comp.withColumnsRenamed({"feature": "j", "component": "other"}), [by, "j"]).where("component = other")

    def cluster(rows: pd.DataFrame) -> pd.DataFrame:
        features = sorted(set(rows["i"]) | set(rows["j"]))
        at = {f: k for k, f in enumerate(features)}
        d = np.ones((len(features), len(features)))
        i, j = rows["i"].map(at).to_numpy(), rows["j"].map(at).to_numpy()
        r = rows["rho"].to_numpy(float)
        d[i, j] = d[j, i] = np.where(np.isnan(r), 1.0, 1 - np.abs(r))
        out = [(t, f, features[k]) for t in cuts for f, k in zip(features, average_linkage(d, 1 - t + 1e-12))]
        return pd.DataFrame(out, columns=["threshold", "feature", "cluster"]).assign(**{by: rows[by].iloc[0]})

    found = inside.groupBy(by, "component").applyInPandas(cluster, f"threshold double, feature string, cluster string, {by} string")
    every = names.select(by, "feature").distinct().withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in cuts])))
    out = every.join(found, [by, "threshold", "feature"], "left")
    return out.select(by, "threshold", "feature", F.coalesce("cluster", "feature").alias("cluster"))


def clusters(long: DataFrame, threshold: float = 0.9, method: str = "spearman", by: str = "reduction_group") -> DataFrame:
    """(by, feature, cluster) of each group's features."""
    long = cut_lineage(long.select(by, "id", "feature", "value"))
    return cut_clusters(cut_lineage(correlations(long, method, (by,))), long, [threshold], by).drop("threshold")


def representatives(long: DataFrame, clustered: DataFrame, by: list[str]) -> DataFrame:
    """Of each cluster the feature of largest sample variance, the first by name among equals."""
    variance = long.groupBy("feature").agg(F.coalesce(F.var_samp("value"), F.lit(0.0)).alias("variance"))
    return top_k(clustered.join(variance, "feature"), by, "variance", 1)


def neutral_reduction(long: DataFrame, gene_method: str = "iqr_top_pct", exclude_shape: bool = True, threshold: float = 0.9, rad: str = "rad", gen: str = "gen", **genes) -> DataFrame:
    """(reduction_group, feature, cluster, variance) of the features kept: imaging texture and
    shape apart (or together), genes after their selection."""
    group = F.when(F.col("block") == gen, "genes").when(F.col("block") == rad, F.when(is_shape(F.col("feature")), "shape").otherwise("texture") if exclude_shape else F.lit("radiomics"))
    cells = cut_lineage(long.withColumn("reduction_group", group).where("reduction_group is not null"))
    if not cells.take(1):
        raise ValueError("no column of a known block")
    imaging, gene = cells.where("reduction_group <> 'genes'"), cells.where("reduction_group = 'genes'")
    kept = variance_filter(imaging).select("feature").union(select_genes(gene, gene_method, **genes).select("feature"))
    cells = cells.join(kept, "feature", "left_semi")
    return representatives(cells, clusters(cells, threshold), ["reduction_group", "cluster"])
