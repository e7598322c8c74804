"""Registered queries of the statistical operators, with the SQL that checks each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ranking, scalars
from ..operators import align, attribution, consensus, hypothesis_tests, metrics, models, multiverse, reduction, resample
from ..sources import sheets
from ..sources.sinks import cut_lineage
from . import mart
from .mart import FOLDS, SEED

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
PLACES = 6


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places: sums may differ in the last bits between engines. Negative zero is zero."""
    return df.select(*[(F.round(c, PLACES) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# Common table expressions of the SQL side.
_SUM = lambda lo: "+".join(f"CAST(embedding[{i}] AS DOUBLE)" for i in range(lo + 1, lo + 9))
C = {
    "vec": "SELECT CAST(vec_id AS VARCHAR) AS id, 'f' || lpad(CAST(i AS VARCHAR), 2, '0') AS feature, CAST(embedding[i+1] AS DOUBLE) AS value FROM embeddings, range(64) r(i)",
    "lab": "SELECT CAST(vec_id AS VARCHAR) AS id, CAST(label < 5 AS INT) AS y FROM embeddings",
    "fol": f"SELECT id, y, CAST((row_number() OVER (ORDER BY y, md5('{SEED}:' || id)) - 1) % {FOLDS} AS INT) AS fold FROM lab",
    "sco": f"SELECT CAST(vec_id AS VARCHAR) AS id, CAST(label < 5 AS INT) AS y, label AS grp, floor(({_SUM(0)}) / 8 * 500) / 500 AS a, floor(({_SUM(8)}) / 8 * 500) / 500 AS b, fold FROM embeddings JOIN (SELECT id AS fid, fold FROM fol) ON fid = CAST(vec_id AS VARCHAR)",
    "pred": "SELECT 'a' AS model, id, fold, y, a AS p, CAST(a > 0 AS INT) AS pred FROM sco UNION ALL SELECT 'b', id, fold, y, b, CAST(b > 0 AS INT) FROM sco",
    "conf": "SELECT model, fold, CAST(sum(CAST(y=1 AND pred=1 AS INT)) AS BIGINT) AS tp, CAST(sum(CAST(y=0 AND pred=1 AS INT)) AS BIGINT) AS fp, CAST(sum(CAST(y=1 AND pred=0 AS INT)) AS BIGINT) AS fn, CAST(sum(CAST(y=0 AND pred=0 AS INT)) AS BIGINT) AS tn FROM pred GROUP BY ALL",
    "mid": "SELECT *, rank() OVER (PARTITION BY model, fold ORDER BY p) + (count(*) OVER (PARTITION BY model, fold, p) - 1) / 2.0::DOUBLE AS r FROM pred",
    "auc": "SELECT model, fold, (sum(CASE WHEN y=1 THEN r END) - sum(y)*(sum(y)+1)/2.0::DOUBLE) / nullif(CAST(sum(y) AS DOUBLE)*sum(1-y), 0) AS auc, CAST(sum(y) AS BIGINT) AS n_pos, CAST(sum(1-y) AS BIGINT) AS n_neg FROM mid GROUP BY ALL",
    "fm": "SELECT model, fold, auc, (tp/CAST(tp+fn AS DOUBLE) + tn/CAST(tn+fp AS DOUBLE))/2 AS balanced_accuracy, coalesce(2.0::DOUBLE*tp/nullif(2*tp+fp+fn,0),0) AS f1 FROM auc JOIN conf USING (model, fold)",
    "img": """SELECT CAST(o_custkey AS VARCHAR) AS id, CAST(count(*) AS DOUBLE) AS rad__n_items, CAST(count(DISTINCT o_orderkey) AS DOUBLE) AS rad__n_orders, round(sum(l_quantity),4) AS rad__quantity_sum,
      round(avg(l_quantity),6) AS rad__quantity_mean, round(max(l_extendedprice),4) AS rad__price_max, round(sum(l_extendedprice),2) AS rad__price_sum, round(min(l_extendedprice),4) AS rad__shape_price_min,
      round(avg(l_discount),6) AS "rad__Shape_discount_mean", round(avg(l_tax),6) AS rad__tax_mean, CAST(max(l_linenumber) AS DOUBLE) AS rad__shape_lines_max
      FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey""",
    "imgl": "UNPIVOT img ON COLUMNS(* EXCLUDE id) INTO NAME feature VALUE value",
    "gen": """SELECT CAST(user_id AS VARCHAR) AS id, event_type, coalesce(n,0) AS n, coalesce(total,0) AS total, coalesce(top,0) AS top FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT DISTINCT event_type FROM events) t
      LEFT JOIN (SELECT user_id, event_type, CAST(count(*) AS DOUBLE) AS n, round(sum(value),4) AS total, round(max(value),4) AS top FROM events GROUP BY ALL) USING (user_id, event_type)""",
    "genl": "SELECT id, 'gen__' || event_type || '_n' AS feature, n AS value FROM gen UNION ALL SELECT id, 'gen__' || event_type || '_total', total FROM gen UNION ALL SELECT id, 'gen__' || event_type || '_top', top FROM gen",
    "blk": "SELECT id, 'rad' AS block, feature, value FROM imgl UNION ALL SELECT id, 'gen', feature, value FROM genl",
    "ali": "SELECT * FROM blk WHERE id IN (SELECT id FROM blk GROUP BY id HAVING count(DISTINCT block) = 2)",
    "coef": f"SELECT o.o AS fold, feature, avg(value) AS mean, CASE WHEN stddev_pop(value) > 0 THEN stddev_pop(value) ELSE 1 END AS sd, avg(CASE WHEN y=1 THEN value END) - avg(CASE WHEN y=0 THEN value END) AS gap FROM vec JOIN fol USING (id), range({FOLDS}) o(o) WHERE o.o <> fold GROUP BY ALL",
    "imp": "SELECT CAST(fold AS INT) AS fold, feature, mean, sd, gap / sd AS importance FROM coef",
    "shap": "SELECT id, feature, importance * (value - mean) / sd AS shap FROM vec JOIN fol USING (id) JOIN imp USING (fold, feature)",
    "pos": "SELECT id, y, row_number() OVER (ORDER BY md5('row:' || id)) - 1 AS pos FROM lab",
    "stat": "SELECT feature, avg(importance) AS mean_coefficient, stddev_samp(importance) AS std_coefficient, avg(abs(importance)) AS mean_abs_coefficient, avg(CAST(abs(importance) > 1e-8 AS DOUBLE)) AS fraction_nonzero, avg(CAST(importance > 1e-8 AS DOUBLE)) AS fraction_positive, avg(CAST(importance < -1e-8 AS DOUBLE)) AS fraction_negative FROM imp GROUP BY feature",
    "msh": "SELECT feature, avg(abs(shap)) AS mean_abs_shap FROM shap GROUP BY feature",
}
# Bootstrap importances: differences of class means on each resample.
N_BOOT, TOP, N_PERM = 200, 8, 200


def _draws(n: int) -> str:
    return f"SELECT CAST(b AS INT) AS b, id, y, count(*) AS times FROM (SELECT b, CAST('0x' || substr(md5('{SEED}:' || b || ':' || pos), 1, 12) AS BIGINT) % (SELECT count(*) FROM pos) AS pos FROM pos, range({n}) r(b)) JOIN pos USING (pos) GROUP BY ALL"


C["draw"] = _draws(N_BOOT)
C["bim"] = "SELECT b, feature, sum(CASE WHEN y=1 THEN times*value END)/sum(CASE WHEN y=1 THEN times END) - sum(CASE WHEN y=0 THEN times*value END)/sum(CASE WHEN y=0 THEN times END) AS importance FROM draw JOIN vec USING (id) GROUP BY ALL"
C["stab"] = f"SELECT feature, count(*) / {float(N_BOOT)}::DOUBLE AS selection_frequency FROM (SELECT b, feature, row_number() OVER (PARTITION BY b ORDER BY abs(importance) DESC, feature) AS r FROM bim) WHERE r <= {TOP} GROUP BY feature"
C["vot"] = f"SELECT feature, count(*) AS n_specs_selected FROM (SELECT fold, feature, row_number() OVER (PARTITION BY fold ORDER BY abs(importance) DESC, feature) AS r FROM imp) WHERE r <= {TOP} GROUP BY feature"
_NEEDS = {
    "fol": ["lab"], "sco": ["fol"], "pred": ["sco"], "conf": ["pred"], "mid": ["pred"], "auc": ["mid"], "fm": ["auc", "conf"], "imgl": ["img"], "genl": ["gen"], "blk": ["imgl", "genl"], "ali": ["blk"],
    "coef": ["vec", "fol"], "imp": ["coef"], "shap": ["vec", "fol", "imp"], "pos": ["lab"], "stat": ["imp"], "msh": ["shap"], "draw": ["pos"], "bim": ["draw", "vec"], "stab": ["bim"], "vot": ["imp"],
}


def sql(select: str, *names: str) -> str:
    order: list[str] = []

    def need(n: str) -> None:
        for m in _NEEDS.get(n, []):
            need(m)
        if n not in order:
            order.append(n)

    for n in names:
        need(n)
    return ("WITH " + ", ".join(f"{n} AS ({C[n]})" for n in order) + " " if order else "") + select


def r(*columns: str) -> str:
    return ", ".join(f"round({c.rsplit(' AS ', 1)[0]}, {PLACES}) + 0.0::DOUBLE AS {c.rsplit(' AS ', 1)[-1]}" for c in columns)


# --- sources, scalars, alignment -------------------------------------------------------------


@query(r"SELECT c_custkey, raw, coalesce(nullif(regexp_extract(raw, '\d+', 0), ''), trim(raw)) AS id FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'Pz ' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') || 'b' WHEN 2 THEN '  ' || c_mktsegment || ' ' ELSE c_name END AS raw FROM customer)")
def normalize_ids(spark, sf):
    k = F.col("c_custkey")
    raw = F.when(k % 4 == 1, F.concat(F.lit("Pz "), F.lpad(k.cast("string"), 6, "0"), F.lit("b"))).when(k % 4 == 2, F.concat(F.lit("  "), "c_mktsegment", F.lit(" "))).when(k % 4 == 3, F.col("c_name"))
    return mart.table(spark, sf, "customer").select("c_custkey", raw.alias("raw")).withColumn("id", scalars.normalize_id(F.col("raw")))


@query("SELECT c_custkey, TRY_CAST(replace(raw, ',', '.') AS DOUBLE) AS value FROM (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'abc' WHEN c_custkey % 7 = 1 THEN '' ELSE CAST(c_custkey AS VARCHAR) || ',' || CAST(c_nationkey AS VARCHAR) END AS raw FROM customer)")
def decimal_comma_parse(spark, sf):
    k = F.col("c_custkey")
    raw = F.when(k % 7 == 0, F.lit("abc")).when(k % 7 == 1, F.lit("")).otherwise(F.concat(k.cast("string"), F.lit(","), F.col("c_nationkey").cast("string")))
    return mart.table(spark, sf, "customer").select("c_custkey", scalars.parse_decimal(raw).alias("value"))


@query("SELECT p_partkey, translate(p_type || '/' || p_brand, '/ ', '__') AS safe, CAST(p_brand = 'Brand#13' AS INT) AS y, nullif(trim(p_name), '') AS label FROM part")
def scalar_names(spark, sf):
    return mart.table(spark, sf, "part").select(
        "p_partkey",
        scalars.safe_name(F.concat_ws("/", "p_type", "p_brand")).alias("safe"),
        scalars.binarize(F.col("p_brand"), "Brand#13").alias("y"),
        scalars.clean_label(F.col("p_name")).alias("label"),
    )


@query("SELECT 'region_' || r_regionkey AS entity, 'key' AS feature, CAST(r_regionkey AS VARCHAR) AS raw FROM region UNION ALL SELECT 'region_' || r_regionkey, 'name', r_name FROM region")
def transposed_sheet(spark, sf):
    """A sheet with attributes in rows (and two trailing columns to drop) read into long form."""
    region = mart.table(spark, sf, "region").select(F.concat(F.lit("region_"), "r_regionkey").alias("entity"), F.col("r_regionkey").cast("string").alias("key"), F.col("r_name").alias("name"))
    sheet = region.unpivot("entity", ["key", "name"], "attribute", "v").groupBy("attribute").pivot("entity").agg(F.first("v"))
    return sheets.transposed(sheets.drop_last(sheet.withColumns({"extra1": F.lit("x"), "extra2": F.lit("y")}), 2))


@query(sql("SELECT id, block, feature, round(value, 4) + 0.0::DOUBLE AS value FROM ali", "ali"))
def align_blocks_inner(spark, sf):
    return mart.aligned(spark, sf).withColumn("value", F.round("value", 4) + F.lit(0.0))


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, n_name AS batch FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 5 <> 0) ON c_nationkey = n_nationkey")
def batch_left_join(spark, sf):
    return align.with_batch(mart.labels(spark, sf).select("id"), mart.batches(spark, sf))


@query("SELECT count(*) AS n_ids, count(n_name) AS n_with_batch, count(DISTINCT n_name) AS n_batches FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 5 <> 0) ON c_nationkey = n_nationkey")
def batch_coverage(spark, sf):
    """How many ids have a batch."""
    rows = align.with_batch(mart.labels(spark, sf).select("id"), mart.batches(spark, sf))
    return rows.agg(F.count("*").alias("n_ids"), F.count("batch").alias("n_with_batch"), F.countDistinct("batch").alias("n_batches"))


@query("SELECT c_mktsegment AS label, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 6) + 0.0::DOUBLE AS pct FROM customer GROUP BY c_mktsegment")
def label_distribution(spark, sf):
    n = mart.labels(spark, sf).groupBy("label").agg(F.count("*").alias("n"))
    return rounded(n.withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy())))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, sf):
    return align.duplicates(mart.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT (SELECT count(*) FROM (SELECT c_custkey FROM customer UNION SELECT user_id FROM events)) AS n_union, (SELECT count(*) FROM (SELECT c_custkey FROM customer INTERSECT SELECT user_id FROM events)) AS n_both, (SELECT count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT user_id FROM events)) AS n_only")
def key_sets(spark, sf):
    a = mart.table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    b = mart.table(spark, sf, "events").select(F.col("user_id").alias("k"))
    parts = [a.union(b).distinct().select(F.lit("n_union").alias("w")), a.intersect(b).select(F.lit("n_both")), a.subtract(b).select(F.lit("n_only"))]
    every = parts[0].union(parts[1]).union(parts[2])
    return every.agg(*[F.count(F.when(F.col("w") == w, 1)).alias(w) for w in ("n_union", "n_both", "n_only")])


# --- reduction -------------------------------------------------------------------------------


@query(sql(f"SELECT id, feature, round((value - avg(value) OVER w) / nullif(stddev_pop(value) OVER w, 0), {PLACES}) + 0.0::DOUBLE AS z FROM vec WINDOW w AS (PARTITION BY feature)", "vec"))
def zscore_features(spark, sf):
    return rounded(reduction.zscores(mart.vectors(spark, sf)).select("id", "feature", "z"))


_WITH_CONSTANT = "SELECT * FROM vec UNION ALL SELECT DISTINCT id, 'constant', 1.0::DOUBLE FROM vec"


@query(sql(f"SELECT feature, {r('stddev_pop(value) AS sd')} FROM ({_WITH_CONSTANT}) GROUP BY feature HAVING stddev_pop(value) > 0", "vec"))
def variance_filter(spark, sf):
    v = mart.vectors(spark, sf)
    constant = v.select("id").distinct().select("id", F.lit("constant").alias("feature"), F.lit(1.0).alias("value"))
    return rounded(reduction.variance_filter(v.unionByName(constant)))


_IQR = "SELECT feature, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS score FROM vec GROUP BY feature"


@query(sql(f"SELECT feature, {r('score')} FROM ({_IQR}) ORDER BY score DESC, feature LIMIT 10", "vec"))
def gene_iqr_top_n(spark, sf):
    return rounded(reduction.select_genes(mart.vectors(spark, sf), "iqr_top_n", top_n=10))


@query(sql(f"SELECT feature, {r('score')} FROM (SELECT *, row_number() OVER (ORDER BY score DESC, feature) AS k, count(*) OVER () AS n FROM ({_IQR})) WHERE k <= greatest(1, floor(n * 0.05))", "vec"))
def gene_iqr_top_pct(spark, sf):
    return rounded(reduction.select_genes(mart.vectors(spark, sf), "iqr_top_pct"))


@query(sql(f"SELECT feature, {r('score')} FROM ({_IQR}) WHERE score > 0.17", "vec"))
def gene_iqr_threshold(spark, sf):
    return rounded(reduction.select_genes(mart.vectors(spark, sf), "iqr_threshold", threshold=0.17))


@query(sql("SELECT DISTINCT feature, contains(lower(feature), 'shape') AS is_shape FROM blk", "blk"))
def shape_split(spark, sf):
    return mart.blocks(spark, sf).select("feature", scalars.is_shape(F.col("feature")).alias("is_shape")).distinct()


_RANKED = "SELECT id, feature, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0::DOUBLE AS rk FROM vec"
_RHO = f"SELECT a.feature AS i, b.feature AS j, corr(a.rk, b.rk) AS rho FROM ({_RANKED}) a JOIN ({_RANKED}) b ON a.id = b.id AND a.feature < b.feature GROUP BY ALL"


@query(sql(f"SELECT i, j, {r('rho')} FROM ({_RHO})", "vec"))
def spearman_matrix(spark, sf):
    return rounded(reduction.correlations(mart.vectors(spark, sf)))


@query(sql(f"SELECT i, j, {r('1 - abs(rho) AS distance')} FROM ({_RHO})", "vec"))
def corr_distance(spark, sf):
    return rounded(reduction.distances(reduction.correlations(mart.vectors(spark, sf))))


@query(sql("SELECT i, j, round(corr(a.value, b.value), 6) + 0.0::DOUBLE AS rho FROM (SELECT id, feature AS i, value FROM vec) a JOIN (SELECT id, feature AS j, value FROM vec) b USING (id) WHERE i < j GROUP BY ALL", "vec"))
def pearson_matrix(spark, sf):
    return rounded(reduction.correlations(mart.vectors(spark, sf), "pearson"))


@query(sql(f"SELECT cluster, feature, {r('variance')} FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY variance DESC, feature) AS k FROM (SELECT right(feature, 1) AS cluster, feature, var_samp(value) AS variance FROM vec GROUP BY ALL)) WHERE k = 1", "vec"))
def cluster_representative(spark, sf):
    v = mart.vectors(spark, sf)
    given = v.select("feature", F.substring("feature", -1, 1).alias("cluster")).distinct()
    return rounded(reduction.representatives(v, given, ["cluster"]).select("cluster", "feature", "variance"))


# --- resampling ------------------------------------------------------------------------------


@query(sql("SELECT id, y, fold FROM fol", "fol"))
def stratified_folds(spark, sf):
    return resample.stratified_folds(mart.vector_labels(spark, sf), FOLDS, SEED).select("id", "y", "fold")


@query(sql(f"SELECT CAST(o AS INT) AS outer_fold, id, y, CAST((row_number() OVER (PARTITION BY o ORDER BY y, md5('{SEED}:' || id)) - 1) % {FOLDS} AS INT) AS inner_fold FROM fol, range({FOLDS}) r(o) WHERE o <> fold", "fol"))
def inner_folds(spark, sf):
    folds = resample.stratified_folds(mart.vector_labels(spark, sf), FOLDS, SEED)
    return resample.inner_folds(folds, FOLDS, SEED, FOLDS).select(F.col("outer").alias("outer_fold"), "id", "y", F.col("inner").alias("inner_fold"))


@query(sql("SELECT b, id, y, times FROM draw", "draw"))
def bootstrap_indices(spark, sf):
    return resample.bootstrap_counts(mart.vector_labels(spark, sf), N_BOOT, SEED)


_PERM = f"SELECT CAST(perm AS INT) AS perm, i.id, l.y FROM (SELECT perm, id, row_number() OVER (PARTITION BY perm ORDER BY md5('{SEED}:id:' || perm || ':' || id)) AS k FROM lab, range({N_PERM}) r(perm)) i JOIN (SELECT perm, y, row_number() OVER (PARTITION BY perm ORDER BY md5('{SEED}:y:' || perm || ':' || id)) AS k FROM lab, range({N_PERM}) r(perm)) l USING (perm, k)"


@query(sql(_PERM, "lab"))
def permuted_labels(spark, sf):
    return resample.permuted_labels(mart.vector_labels(spark, sf), N_PERM, SEED)


@query(sql(f"SELECT fold, feature, {r('mean', 'sd')} FROM imp", "imp"))
def train_fold_standardize(spark, sf):
    return rounded(mart.fold_coefficients(spark, sf).select("fold", "feature", "mean", "sd"))


# --- metrics ---------------------------------------------------------------------------------


@query(sql("SELECT model, fold, id, r AS midrank FROM mid", "mid"))
def midrank(spark, sf):
    return ranking.with_midrank(mart.predictions(spark, sf), ["model", "fold"], "p", "midrank").select("model", "fold", "id", "midrank")


@query(sql(f"SELECT model, fold, {r('auc')}, n_pos, n_neg FROM auc", "auc"))
def roc_auc_by_fold(spark, sf):
    return rounded(metrics.roc_auc(mart.predictions(spark, sf), ["model", "fold"]))


@query(sql("SELECT model, fold, tp, fp, fn, tn FROM conf", "conf"))
def confusion_by_fold(spark, sf):
    return metrics.confusion(mart.predictions(spark, sf), ["model", "fold"])


@query(sql(f"SELECT model, fold, {r('balanced_accuracy')} FROM fm", "fm"))
def balanced_accuracy(spark, sf):
    return rounded(metrics.fold_metrics(mart.predictions(spark, sf), ["model", "fold"]).select("model", "fold", "balanced_accuracy"))


@query(sql(f"SELECT model, fold, {r('f1')} FROM fm", "fm"))
def f1(spark, sf):
    return rounded(metrics.fold_metrics(mart.predictions(spark, sf), ["model", "fold"]).select("model", "fold", "f1"))


@query(sql("SELECT model, " + r(*[f"{a}({m}) AS {m}_{s}" for m in ("auc", "balanced_accuracy", "f1") for a, s in (("avg", "mean"), ("stddev_pop", "sd"))]) + " FROM fm GROUP BY model", "fm"))
def fold_summary(spark, sf):
    return rounded(metrics.fold_summary(metrics.fold_metrics(mart.predictions(spark, sf), ["model", "fold"]), ["model"]))


_POOLED = """SELECT model, round((sum(CASE WHEN y=1 THEN r END) - sum(y)*(sum(y)+1)/2.0::DOUBLE) / (CAST(sum(y) AS DOUBLE)*sum(1-y)), 6) + 0.0::DOUBLE AS pooled_oof_auc,
 round((sum(CAST(y=1 AND pred=1 AS INT))/CAST(sum(y) AS DOUBLE) + sum(CAST(y=0 AND pred=0 AS INT))/CAST(sum(1-y) AS DOUBLE))/2, 6) + 0.0::DOUBLE AS pooled_oof_balanced_accuracy,
 round(coalesce(2.0::DOUBLE*sum(y*pred)/nullif(sum(y)+sum(pred),0),0), 6) + 0.0::DOUBLE AS pooled_oof_f1
 FROM (SELECT *, rank() OVER (PARTITION BY model ORDER BY p) + (count(*) OVER (PARTITION BY model, p) - 1) / 2.0::DOUBLE AS r FROM pred) GROUP BY model"""


@query(sql(_POOLED, "pred"))
def pooled_oof_metrics(spark, sf):
    return rounded(metrics.pooled(mart.predictions(spark, sf), ["model"]))


@query(sql("SELECT model, count(*) AS n_ids, CAST(sum(CAST(n > 1 AS INT)) AS BIGINT) AS n_twice, (SELECT count(*) FROM lab) - count(*) AS n_never, CAST(0 AS BIGINT) AS n_bad_class FROM (SELECT model, id, count(*) AS n FROM (SELECT * FROM pred WHERE NOT (model = 'b' AND fold = 1) UNION ALL SELECT * FROM pred WHERE fold = 0) GROUP BY ALL) GROUP BY model", "pred"))
def oof_integrity(spark, sf):
    p = mart.predictions(spark, sf)
    broken = p.where("not (model = 'b' and fold = 1)").unionByName(p.where("fold = 0"))
    return metrics.oof_integrity(broken, mart.vector_labels(spark, sf), ["model"])


@query(sql("SELECT model, CAST(least(floor((p - lo) / ((hi - lo) / 20)), 19) AS INT) AS bin, count(*) AS n FROM (SELECT *, min(p) OVER (PARTITION BY model) AS lo, max(p) OVER (PARTITION BY model) AS hi FROM pred) GROUP BY ALL", "pred"))
def histogram_bins(spark, sf):
    return metrics.histogram(mart.predictions(spark, sf), "p", 20, ["model"])


@query(sql(f"SELECT model, count(*) AS n_folds, {r('min(auc) AS auc_min', 'max(auc) AS auc_max')} FROM auc GROUP BY model", "auc"))
def auc_range(spark, sf):
    """Size of each model's group of results, and the range of their AUCs."""
    auc = metrics.roc_auc(mart.predictions(spark, sf), ["model", "fold"])
    return rounded(auc.groupBy("model").agg(F.count("*").alias("n_folds"), F.min("auc").alias("auc_min"), F.max("auc").alias("auc_max")))


@query(sql(_POOLED + " ORDER BY pooled_oof_auc DESC, model LIMIT 1", "pred"))
def best_model(spark, sf):
    return rounded(metrics.pooled(mart.predictions(spark, sf), ["model"])).orderBy(F.desc("pooled_oof_auc"), "model").limit(1)


# --- tests -----------------------------------------------------------------------------------

_BOOT = 2000


def _simpson(density: Callable[[str], str], to: str) -> str:
    """SQL: the integral of a density from 0, by 2,000 parabolas."""
    at = f"(i / 4000.0::DOUBLE * ({to}))"
    return f"(({to}) / 12000 * list_sum(list_transform(range(4001), lambda i: (CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * ({density(at)}))))"


def _normal_tails(z: str) -> str:
    return f"(1 - sqrt(2 / pi()) * {_simpson(lambda t: f'exp(-{t} * {t} / 2)', f'least(abs({z}), 40)')})"


def _chi2_tail(x: str, df: str) -> str:
    return f"(1 - {_simpson(lambda t: f'pow({t}, ({df}) / 2.0::DOUBLE - 1) * exp(-{t} / 2)', x)} / (pow(2, ({df}) / 2.0::DOUBLE) * gamma(({df}) / 2.0::DOUBLE)))"


_BAUC = "SELECT b, m, (sum(CASE WHEN y=1 THEN t * (below + own/2) END)) / (sum(CASE WHEN y=1 THEN t END) * sum(CASE WHEN y=0 THEN t END)) AS auc FROM (SELECT b, m, y, p, t, sum(CASE WHEN y=0 THEN t ELSE 0 END) OVER (PARTITION BY b, m ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - own AS below, own FROM (SELECT *, sum(CASE WHEN y=0 THEN t ELSE 0 END) OVER (PARTITION BY b, m, p) AS own FROM (SELECT d.b AS b, 'a' AS m, d.y, a AS p, CAST(times AS DOUBLE) AS t FROM dr d JOIN sco USING (id) UNION ALL SELECT d.b, 'b', d.y, b_ AS p, CAST(times AS DOUBLE) FROM dr d JOIN (SELECT id, b AS b_ FROM sco) USING (id)))) GROUP BY ALL"
_OBS = "SELECT max(CASE WHEN model='b' THEN auc END) - max(CASE WHEN model='a' THEN auc END) AS observed FROM (SELECT model, (sum(CASE WHEN y=1 THEN r END) - sum(y)*(sum(y)+1)/2.0::DOUBLE) / (CAST(sum(y) AS DOUBLE)*sum(1-y)) AS auc FROM (SELECT *, rank() OVER (PARTITION BY model ORDER BY p) + (count(*) OVER (PARTITION BY model, p) - 1) / 2.0::DOUBLE AS r FROM pred) GROUP BY model)"
_DIFFS = sql("SELECT b, round(max(CASE WHEN m='b' THEN auc END) - max(CASE WHEN m='a' THEN auc END), 9) AS diff FROM bauc GROUP BY b", "sco", "pos", "pred").replace(" SELECT b, round(max", f", dr AS ({_draws(_BOOT)}), bauc AS ({_BAUC}), obs AS ({_OBS}) SELECT b, round(max")


def _paired_diffs(spark, sf):
    pairs = cut_lineage(mart.scored(spark, sf).select("id", "y", "a", "b"))
    diffs = hypothesis_tests.paired_auc_diffs(pairs, _BOOT, SEED).withColumn("diff", F.round("diff", 9))
    return diffs.join(F.broadcast(hypothesis_tests.auc_diff(pairs)))  # one row


@query(_DIFFS.rsplit(" SELECT b, round(max", 1)[0] + f" SELECT {r('(SELECT observed FROM obs) AS observed', 'quantile_cont(diff, 0.025) AS ci_low', 'quantile_cont(diff, 0.975) AS ci_high', 'least(1.0::DOUBLE, 2 * CASE WHEN (SELECT observed FROM obs) >= 0 THEN avg(CAST(diff <= 0 AS DOUBLE)) ELSE avg(CAST(diff >= 0 AS DOUBLE)) END) AS p_value')}, count(*) AS n FROM (SELECT b, round(max(CASE WHEN m='b' THEN auc END) - max(CASE WHEN m='a' THEN auc END), 9) AS diff FROM bauc GROUP BY b)")
def paired_bootstrap_auc_diff(spark, sf):
    return rounded(hypothesis_tests.bootstrap_summary(_paired_diffs(spark, sf)))


_DIFF = _DIFFS.rsplit(" SELECT b, round(max", 1)[0] + ", df AS (SELECT round(max(CASE WHEN m='b' THEN auc END) - max(CASE WHEN m='a' THEN auc END), 9) AS diff FROM bauc GROUP BY b)"


@query(_DIFF + " SELECT CAST(least(floor((diff - lo) / ((hi - lo) / 40)), 39) AS INT) AS bin, count(*) AS n FROM (SELECT *, min(diff) OVER () AS lo, max(diff) OVER () AS hi FROM df) GROUP BY ALL")
def bootstrap_histogram(spark, sf):
    """Bootstrap differences of AUC in bins of equal width."""
    return metrics.histogram(_paired_diffs(spark, sf), "diff", 40)


_VCOMP = "SELECT model, id, y, CASE WHEN y=1 THEN (ra - ro)/n ELSE 1 - (ra - ro)/m END AS v FROM (SELECT *, rank() OVER (PARTITION BY model ORDER BY p) + (count(*) OVER (PARTITION BY model, p) - 1) / 2.0::DOUBLE AS ra, rank() OVER (PARTITION BY model, y ORDER BY p) + (count(*) OVER (PARTITION BY model, y, p) - 1) / 2.0::DOUBLE AS ro, CAST(sum(y) OVER (PARTITION BY model) AS DOUBLE) AS m, CAST(sum(1-y) OVER (PARTITION BY model) AS DOUBLE) AS n FROM pred)"


@query(sql(f"SELECT model, id, y, {r('v')} FROM ({_VCOMP})", "pred"))
def delong_components(spark, sf):
    return rounded(hypothesis_tests.delong_components(mart.scored(spark, sf).select("id", "y", "a", "b"), []))


_DELONG = f"""SELECT {r('auc_a', 'auc_b', 'auc_b - auc_a AS diff', 'sqrt(var) AS se_diff', 'auc_b - auc_a - 1.96 * sqrt(var) AS ci_low', 'auc_b - auc_a + 1.96 * sqrt(var) AS ci_high', '(auc_b - auc_a) / sqrt(var) AS z', _normal_tails('(auc_b - auc_a) / sqrt(var)') + ' AS p_value')} FROM (
 SELECT max(CASE WHEN y=1 THEN ma END) AS auc_a, max(CASE WHEN y=1 THEN mb END) AS auc_b, sum(part) AS var FROM (
  SELECT y, avg(va) AS ma, avg(vb) AS mb, (var_samp(va) + var_samp(vb) - 2 * covar_samp(va, vb)) / count(*) AS part FROM (
   SELECT id, y, max(CASE WHEN model='a' THEN v END) AS va, max(CASE WHEN model='b' THEN v END) AS vb FROM ({_VCOMP}) GROUP BY ALL) GROUP BY y))"""


@query(sql(_DELONG, "pred"))
def delong_test(spark, sf):
    return rounded(hypothesis_tests.delong(mart.scored(spark, sf).select("id", "y", "a", "b"), []))


def _compared() -> str:
    order = ", ".join([f"{n} AS ({C[n]})" for n in ("lab", "fol")] + [f"every AS ({C['sco']})", "sco AS (SELECT * FROM every WHERE fold <> 4)", f"pred AS ({C['pred']})"])
    pos = "pos AS (SELECT id, y, row_number() OVER (ORDER BY md5('row:' || id)) - 1 AS pos FROM sco)"
    diffs = "df AS (SELECT b, round(max(CASE WHEN m='b' THEN auc END) - max(CASE WHEN m='a' THEN auc END), 9) AS diff FROM bauc GROUP BY b)"
    boot = r("quantile_cont(diff, 0.025) AS boot_ci_low", "quantile_cont(diff, 0.975) AS boot_ci_high", "least(1.0::DOUBLE, 2 * CASE WHEN (SELECT observed FROM obs) >= 0 THEN avg(CAST(diff <= 0 AS DOUBLE)) ELSE avg(CAST(diff >= 0 AS DOUBLE)) END) AS boot_p_value")
    return f"""WITH {order}, {pos}, dr AS ({_draws(_BOOT)}), bauc AS ({_BAUC}), obs AS ({_OBS}), {diffs}, t AS ({_DELONG}), x AS (SELECT {boot} FROM df)
 SELECT (SELECT count(*) FROM sco) AS n_joined, (SELECT count(*) FROM every) - (SELECT count(*) FROM sco) AS n_dropped, t.*, x.*, p_value < 0.05 AS differs_by_test, boot_ci_low > 0 OR boot_ci_high < 0 AS differs_by_interval FROM t CROSS JOIN x"""


@query(_compared())
def compare_sources(spark, sf):
    """Two sources' out-of-fold tables, one of which lacks a fold: inner by id, labels checked, then
    both tests of the difference and their verdicts."""
    p = mart.predictions(spark, sf)
    one, two = p.where("model = 'a'"), p.where("model = 'b' and fold <> 4")
    pairs = cut_lineage(align.pair_results(one, two))
    n_joined = pairs.agg(F.count("*").alias("n_joined"))
    n_one = one.agg(F.count("*").alias("n_one"))
    counts = n_joined.join(F.broadcast(n_one)).select("n_joined", (F.col("n_one") - F.col("n_joined")).alias("n_dropped"))  # one row each
    diffs = hypothesis_tests.paired_auc_diffs(pairs, _BOOT, SEED).withColumn("diff", F.round("diff", 9))
    return rounded(hypothesis_tests.compared(pairs, diffs).join(F.broadcast(counts)))


@query(sql(f"SELECT {r('auc_real', 'p_value', 'perm_mean', 'perm_sd')} FROM (SELECT max(re) AS auc_real, (sum(CAST(auc >= re AS INT)) + 1) / CAST(count(*) + 1 AS DOUBLE) AS p_value, avg(auc) AS perm_mean, stddev_pop(auc) AS perm_sd FROM (SELECT perm, (sum(CASE WHEN y=1 THEN rk END) - sum(y)*(sum(y)+1)/2.0::DOUBLE) / (CAST(sum(y) AS DOUBLE)*sum(1-y)) AS auc FROM ({_PERM}) JOIN ra USING (id) GROUP BY perm) CROSS JOIN (SELECT (sum(CASE WHEN y=1 THEN rk END) - sum(y)*(sum(y)+1)/2.0::DOUBLE) / (CAST(sum(y) AS DOUBLE)*sum(1-y)) AS re FROM ra))", "sco").replace(" SELECT round(auc_real", ", ra AS (SELECT id, y, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0::DOUBLE AS rk FROM sco) SELECT round(auc_real", 1).replace("JOIN ra USING (id)", "JOIN (SELECT id, rk FROM ra) USING (id)"))
def permutation_pvalue(spark, sf):
    s = mart.scored(spark, sf)
    perms = resample.permuted_labels(s.select("id", "y"), N_PERM, SEED).join(s.select("id", F.col("a").alias("p")), "id")
    real = metrics.roc_auc(s.withColumnRenamed("a", "p"), []).select(F.col("auc").alias("auc_real"))
    return rounded(hypothesis_tests.permutation_summary(metrics.roc_auc(perms, ["perm"]).join(F.broadcast(real))))  # one row


_KW = "SELECT (12.0::DOUBLE / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - ties / (CAST(n AS DOUBLE) * n * n - n)) AS h, df, n FROM (SELECT sum(part) AS s, CAST(sum(m) AS BIGINT) AS n, count(*) - 1 AS df FROM (SELECT grp, sum(rk) * sum(rk) / count(*) AS part, count(*) AS m FROM (SELECT grp, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0::DOUBLE AS rk FROM sco) GROUP BY grp)) CROSS JOIN (SELECT sum(t * t * t - t) AS ties FROM (SELECT CAST(count(*) AS DOUBLE) AS t FROM sco GROUP BY a))"


@query(sql(f"SELECT {r('h')}, df, n, {r(_chi2_tail('h', 'df') + ' AS p_value')} FROM ({_KW})", "sco"))
def kruskal_wallis_h(spark, sf):
    return rounded(hypothesis_tests.kruskal_wallis(mart.scored(spark, sf), "a", "grp", []))


# --- importances -----------------------------------------------------------------------------


@query("SELECT o_orderstatus, o_orderpriority AS params, n_folds, first_fold FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY n_folds DESC, first_fold) AS k FROM (SELECT o_orderstatus, o_orderpriority, count(*) AS n_folds, min(o_orderkey) AS first_fold FROM orders GROUP BY ALL)) WHERE k = 1")
def majority_vote_params(spark, sf):
    votes = mart.table(spark, sf, "orders").select("o_orderstatus", F.col("o_orderpriority").alias("params"), F.col("o_orderkey").alias("fold"))
    return consensus.majority_params(votes, ["o_orderstatus"])


def _boot_importances(spark, sf):
    drawn = resample.bootstrap_counts(mart.vector_labels(spark, sf), N_BOOT, SEED)
    mean = lambda y: F.sum(F.when(F.col("y") == y, F.col("times") * F.col("value"))) / F.sum(F.when(F.col("y") == y, F.col("times")))
    return drawn.join(mart.vectors(spark, sf), "id").groupBy("b", "feature").agg((mean(1) - mean(0)).alias("importance"))


@query(sql("SELECT feature, selection_frequency FROM stab", "stab"))
def stability_frequency(spark, sf):
    return consensus.stability(_boot_importances(spark, sf), ["b"], TOP, N_BOOT)


def _shap(spark, sf):
    folds = resample.stratified_folds(mart.vector_labels(spark, sf), FOLDS, SEED)
    rows = mart.vectors(spark, sf).join(folds, "id").join(mart.fold_coefficients(spark, sf), ["fold", "feature"])
    return rows.select("id", "feature", (F.col("importance") * (F.col("value") - F.col("mean")) / F.col("sd")).alias("shap"))


@query(sql(f"SELECT id, feature, {r('shap')} FROM shap", "shap"))
def linear_shap(spark, sf):
    return rounded(_shap(spark, sf))


@query(sql(f"SELECT feature, {r('mean_abs_shap', 'mean_abs_shap / sum(mean_abs_shap) OVER () * 100 AS pct')} FROM msh", "msh"))
def mean_abs_shap_pct(spark, sf):
    return rounded(consensus.mean_abs(_shap(spark, sf)))


_STATS = ("mean_coefficient", "std_coefficient", "mean_abs_coefficient", "fraction_nonzero", "fraction_positive", "fraction_negative")


@query(sql(f"SELECT feature, {r(*_STATS)} FROM stat", "stat"))
def feature_stats(spark, sf):
    return rounded(consensus.feature_stats(mart.fold_coefficients(spark, sf), []))


@query(sql("SELECT bool_and(fraction_nonzero = 0) AS collapsed_model FROM stat", "stat"))
def collapsed_model(spark, sf):
    return consensus.collapsed(consensus.feature_stats(mart.fold_coefficients(spark, sf), []), [])


def _votes(spark, sf):
    per = mart.fold_coefficients(spark, sf).withColumn("mean_abs_coefficient", F.abs("importance"))
    return consensus.votes(per, ["fold"], TOP)


@query(sql(f"SELECT feature, n_specs_selected, {r(f'n_specs_selected * 100.0::DOUBLE / {FOLDS} AS pct')} FROM vot", "vot"))
def vote_percents(spark, sf):
    """Votes as shares of the specifications, as a bar chart shows them."""
    return rounded(_votes(spark, sf).withColumn("pct", F.col("n_specs_selected") * F.lit(100.0) / FOLDS))


@query(sql("SELECT feature, n_specs_selected FROM vot", "vot"))
def feature_votes(spark, sf):
    return _votes(spark, sf)


@query(sql("SELECT feature, CAST(sum(n) AS BIGINT) AS n FROM (SELECT feature, n_specs_selected AS n FROM vot UNION ALL SELECT feature, count(*) FROM bim WHERE importance > 0 GROUP BY feature) GROUP BY feature", "vot", "bim"))
def vote_accumulate(spark, sf):
    positive = _boot_importances(spark, sf).where("importance > 0").groupBy("feature").agg(F.count("*").alias("n"))
    return align.add_filled([_votes(spark, sf).withColumnRenamed("n_specs_selected", "n"), positive], "feature", "n")


_GRID = "SELECT data_source, gene_selection_method, exclude_shape, CAST(redundancy_corr_threshold AS DOUBLE) AS redundancy_corr_threshold FROM (VALUES ('imaging'), ('genes'), ('both')) a(data_source), (VALUES ('variance'), ('iqr_top_pct'), ('iqr_top_n')) b(gene_selection_method), (VALUES (true), (false)) c(exclude_shape), (VALUES (0.80), (0.90), (0.95)) d(redundancy_corr_threshold)"


_SIZES = "s AS (SELECT count(*) FILTER (block = 'rad') AS rad, count(*) FILTER (block = 'gen') AS gen FROM (SELECT DISTINCT block, feature FROM blk))"
_N = "CASE data_source WHEN 'imaging' THEN rad WHEN 'genes' THEN gen ELSE rad + gen END AS n_candidates"


def _candidates(spark, sf, specs):
    """Specifications with how many of the table's features they choose from."""
    n = lambda b: F.countDistinct(F.when(F.col("block") == b, F.col("feature")))
    sizes = mart.blocks(spark, sf).agg(n("rad").alias("rad"), n("gen").alias("gen"))  # one row
    own = F.when(F.col("data_source") == "imaging", F.col("rad")).when(F.col("data_source") == "genes", F.col("gen")).otherwise(F.col("rad") + F.col("gen"))
    return specs.join(F.broadcast(sizes)).withColumn("n_candidates", own).drop("rad", "gen")


@query(sql("", "blk") + f", {_SIZES} SELECT g.*, {_N} FROM ({_GRID}) g CROSS JOIN s")
def spec_grid(spark, sf):
    return _candidates(spark, sf, multiverse.spec_grid(spark))


@query(sql("", "blk") + f", {_SIZES} SELECT data_source, CASE WHEN data_source <> 'imaging' THEN gene_selection_method END AS gene_selection_method, CASE WHEN data_source <> 'genes' THEN exclude_shape END AS exclude_shape, redundancy_corr_threshold, count(*) AS multiplicity, any_value({_N.rsplit(' AS ', 1)[0]}) AS n_candidates FROM ({_GRID}) g CROSS JOIN s GROUP BY ALL")
def spec_dedup(spark, sf):
    return _candidates(spark, sf, multiverse.distinct_specs(multiverse.spec_grid(spark)))


_NR = lambda c: f"CASE WHEN count(*) OVER () <= 1 THEN 0 ELSE (rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE - 1) / (count(*) OVER () - 1) END"


@query(sql(f"SELECT feature, {r('stability_selection_freq', 'shap_mean_abs', 'spec_curve_votes', 'rank_stability', 'rank_shap', 'rank_spec_votes', '(rank_stability + rank_shap + rank_spec_votes) / 3 AS consensus_score')}, CAST(stability_selection_freq > 0 AS INT) + CAST(shap_mean_abs > 0 AS INT) + CAST(spec_curve_votes > 0 AS INT) AS n_criteria_present FROM (SELECT *, {_NR('stability_selection_freq')} AS rank_stability, {_NR('shap_mean_abs')} AS rank_shap, {_NR('spec_curve_votes')} AS rank_spec_votes FROM (SELECT feature, coalesce(selection_frequency, 0) AS stability_selection_freq, coalesce(mean_abs_shap, 0) AS shap_mean_abs, coalesce(CAST(n_specs_selected AS DOUBLE), 0) AS spec_curve_votes FROM stab FULL JOIN msh USING (feature) FULL JOIN vot USING (feature)))", "stab", "msh", "vot"))
def consensus_rank(spark, sf):
    stable = consensus.stability(_boot_importances(spark, sf), ["b"], TOP, N_BOOT)
    return rounded(consensus.consensus(stable, consensus.mean_abs(_shap(spark, sf)), _votes(spark, sf)))


# --- models: results that SQL can't express --------------------------------------------------

def _cohort(spark, sf):
    return models.Cohort.of(mart.vectors(spark, sf), mart.vector_labels(spark, sf))


def _nested(name):
    def run(spark, sf):
        result = models.nested_cv(spark, _cohort(spark, sf), [name], 5, 5, SEED)
        return result.metrics.join(result.best, ["model", "fold"])

    run.__name__ = "nested_cv_" + {"svm_linear": "svm", "random_forest": "forest"}.get(name, name)
    return run


for _name in models.MODELS:
    query()(_nested(_name))


@query()
def redundancy_clusters(spark, sf):
    v = cut_lineage(mart.aligned(spark, sf).withColumn("reduction_group", F.col("block")))
    return reduction.clusters(v.join(reduction.variance_filter(v).select("feature"), "feature", "left_semi"), 0.8)


@query()
def neutral_reduction(spark, sf):
    return reduction.neutral_reduction(mart.aligned(spark, sf), "iqr_top_n", top_n=10)


@query()
def stability_selection(spark, sf):
    cohort = _cohort(spark, sf)
    n = 200
    boot = models.bootstrap_importances(spark, cohort, "elastic_net", {"C": 0.1, "l1_ratio": 0.5}, n, SEED)
    return consensus.stability(boot, ["b"], max(5, int(len(cohort.features) ** 0.5)), n)


@query()
def tree_shap(spark, sf):
    """Mean attributions of the boosted trees that a whole grid search chose in each fold."""
    return consensus.mean_abs(models.nested_cv(spark, _cohort(spark, sf), ["gbt"], 5, 5, SEED).attributions)


@query()
def permutation_test(spark, sf):
    perms = models.permutation_test(spark, _cohort(spark, sf), "elastic_net", {"C": 0.1, "l1_ratio": 0.5}, N_PERM, 5, SEED)
    return hypothesis_tests.verdicts(hypothesis_tests.permutation_summary(perms))


def _curve(spark, sf):
    """All 54 specifications by both models, 5 folds, 200 trees."""
    return multiverse.spec_curve(spark, mart.aligned(spark, sf), mart.binary_labels(spark, sf), multiverse.spec_grid(spark))


@query()
def spec_curve(spark, sf):
    return _curve(spark, sf)["curve"]


@query()
def pca_scores(spark, sf):
    return multiverse.pca(mart.vectors(spark, sf))


@query("SELECT count(*) AS n, 0.0::DOUBLE AS mean1, 0.0::DOUBLE AS mean2, 0.0::DOUBLE AS corr, 0.0::DOUBLE AS gap1, 0.0::DOUBLE AS gap2, true AS falling FROM embeddings")
def pca_invariants(spark, sf):
    """Components are centred and uncorrelated, and each one's variance is its share of all features'."""
    scores = multiverse.pca(mart.vectors(spark, sf))
    width = mart.vectors(spark, sf).select("feature").distinct().count()
    gap = lambda k: F.var_pop(f"pc{k}") / width - F.max(f"explained{k}")
    return rounded(
        scores.agg(F.count("*").alias("n"), F.avg("pc1").alias("mean1"), F.avg("pc2").alias("mean2"), F.corr("pc1", "pc2").alias("corr"), gap(1).alias("gap1"), gap(2).alias("gap2"), (F.max("explained1") >= F.max("explained2")).alias("falling"))
    )


@query(sql(f"SELECT id, feature, {r('value', 'shap')} FROM shap JOIN vec USING (id, feature) WHERE feature IN (SELECT feature FROM msh ORDER BY mean_abs_shap DESC, feature LIMIT 3)", "shap", "msh", "vec"))
def beeswarm(spark, sf):
    """Each row's value beside its attribution, of the three features of the largest mean attribution."""
    return rounded(attribution.beeswarm(_shap(spark, sf), mart.vectors(spark, sf), 3))


@query()
def dependence(spark, sf):
    """Value and attribution of the top three features beside the value of the one they interact with most."""
    return rounded(attribution.dependence(_shap(spark, sf), mart.vectors(spark, sf), 3))
