"""License notices by diagonal voting.

Every k words in a row of every document are hashed and Spark-joined with the positions of
the same k words in a few fixed notices. Hits of one notice in one document with the same
difference of positions lie on one diagonal; diagonals near each other are one copy of the
notice with words added or missing. A copy counts when enough of the notice's words stand
there, word for word.

Cases: null text is empty; texts with fewer than k words have no hits; repeated rows get the
same answer each; very long texts are rows of k words each, never one row; of equally good
copies each counts, and a document's score is the best coverage; an empty table gives no rows;
further columns aren't read. A null doc_id is an id.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, table, whole_text

#: Rows of k words of all notices up to which they are broadcast (some 20 MB); Spark joins more as it sees fit.
FEW_GRAMS = 200_000

#: What stands between words, in a text whose A-Z are still upper case.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"

#: Phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Label and words of the notices searched by diagonals (public license headers).
NOTICES = {
    "apache-2.0": "licensed under the apache license version 2 0",
    "cc-by-nc-4.0": "licensed under cc by nc 4 0",
    "gpl-3.0": "this work is licensed under the gnu general public license version 3",
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0",
}


def split_words(text: Column) -> Column:
    """The words, and an empty string at the end if the text ends between words."""
    return F.split(F.regexp_replace(text, "^" + GAP + "+", ""), GAP + "+")


def count_words(words: Column) -> Column:
    return (F.size(words) - (F.element_at(words, -1) == "").cast("int")).cast("bigint")


def phrase_places(words: Column, phrases: Mapping[str, str]) -> Column:
    """array<struct(at, label)> of every place of every phrase, in order."""
    low = lambda c: ascii_lower(c)

    def place(word: Column, i: Column) -> Column:
        label = F.lit(None).cast("string")
        for phrase, name in phrases.items():
            parts = phrase.split()
            here = low(word) == parts[0]
            for d, part in enumerate(parts[1:], 1):
                here = here & (low(F.get(words, i + d)) == part)
            label = F.when(here, F.lit(name)).otherwise(label)
        return F.struct(i.cast("bigint").alias("at"), label.alias("label"))

    return F.filter(F.transform(words, place), lambda x: x["label"].isNotNull())


def notice_table(spark: SparkSession, notices: Mapping[str, str], k: int) -> DataFrame:
    """A row for each k words of each notice: as many rows as the fixed notices have words."""
    rows = []
    for name, text in notices.items():
        w = text.split()
        rows += [(name, len(w), q, " ".join(w[q : q + k])) for q in range(len(w) - k + 1)]
    frame = spark.createDataFrame(rows, "notice string, n_notice int, q int, notice_gram string")
    words = F.split("notice_gram", " ")
    return frame.withColumn("h", F.xxhash64(*[F.get(words, F.lit(d)) for d in range(k)]))


def notice_copies(
    docs: DataFrame,
    notices: Mapping[str, str] = NOTICES,
    k: int = 3,
    band: int = 3,
    least: float = 0.6,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row for each verified copy: doc_id, text_hash, notice, first_word, last_word, coverage."""
    spark = docs.sparkSession
    # each row carries its own k words, not the document's: work stays linear in long texts
    words = F.col("words")
    shifted = [words.alias("w0")] + [F.slice(words, d + 1, F.size(words)).alias(f"w{d}") for d in range(1, k)]
    grams = (
        docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("t"))
        .select("doc_id", F.xxhash64("t").alias("text_hash"), split_words(F.col("t")).alias("words"))
        .select("doc_id", "text_hash", F.posexplode_outer(F.arrays_zip(*shifted)).alias("p", "gram"))
        .withColumn("h", F.xxhash64(*[F.lower(F.col(f"gram.w{d}")) for d in range(k)]))
    )
    # two comparisons, so that the text stays out of the join key and is read for hits only
    low = ascii_lower(F.concat_ws(" ", *[F.col(f"gram.w{d}") for d in range(k)]))
    same = (low <= F.col("notice_gram")) & (low >= F.col("notice_gram"))
    listed = notice_table(spark, notices, k)
    few = sum(len(t.split()) for t in notices.values()) <= FEW_GRAMS
    hits = grams.join(F.broadcast(listed) if few else listed, "h").where(same)
    by_diagonal = (
        hits.withColumn("d", F.col("p") - F.col("q"))
        .groupBy("doc_id", "text_hash", "notice", "n_notice", "d", F.floor(F.col("p") / F.col("n_notice")).alias("part"))
        .agg(
            F.min("p").alias("lo"),
            F.max("p").alias("hi"),
            F.collect_set("q").alias("places"),  # no more than the notice has words
        )
    )
    # neighbouring diagonals whose spans meet are one copy
    order = Window.partitionBy("doc_id", "text_hash", "notice").orderBy("lo", "d")
    new = (
        (F.abs(F.col("d") - F.lag("d").over(order)) > band)
        | (F.col("lo") > F.lag("hi").over(order) + band + k)
        | F.lag("d").over(order).isNull()
    )
    copies = by_diagonal.withColumn("new", new.cast("int")).withColumn("copy", F.sum("new").over(order))
    # words of the notice that stand in the copy, each once
    covered = F.array_distinct(F.flatten(F.transform("places", lambda q: F.sequence(q, q + k - 1))))
    return (
        copies.groupBy("doc_id", "text_hash", "notice", "n_notice", "copy")
        .agg(F.min("lo").alias("first_word"), (F.max("hi") + k - 1).alias("last_word"), F.flatten(F.collect_list("places")).alias("places"))
        .withColumn("coverage", F.size(covered) / F.col("n_notice"))
        .where(F.col("coverage") >= least)
        .select("doc_id", "text_hash", "notice", "first_word", "last_word", "coverage")
    )


def scan_licenses(
    docs: DataFrame,
    phrases: Mapping[str, str] = BASE,
    notices: Mapping[str, str] = NOTICES,
    k: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """A row for each document with its phrases, its notices and the best coverage."""
    maybe = "(?i)" + "|".join((GAP + "+").join(p.split()) for p in phrases)
    found = (
        notice_copies(docs, notices, k, id_col=id_col, text_col=text_col)
        .groupBy("doc_id", "text_hash")
        .agg(F.collect_set("notice").alias("found"), F.max("coverage").alias("score"))
        .withColumnRenamed("doc_id", "found_id")
        .withColumnRenamed("text_hash", "found_hash")
    )
    rows = (
        docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("t"))
        .select("doc_id", F.xxhash64("t").alias("text_hash"), F.col("t").rlike(maybe).alias("maybe"), split_words(F.col("t")).alias("words"))
        .select(
            "doc_id",
            "text_hash",
            count_words(F.col("words")).alias("n_words"),
            F.when(F.col("maybe"), phrase_places(F.col("words"), phrases))
            .otherwise(F.array().cast("array<struct<at:bigint,label:string>>"))
            .alias("places"),
        )
        .select(
            "doc_id",
            "text_hash",
            "n_words",
            F.size("places").cast("bigint").alias("n_base"),
            F.array_min(F.col("places.at")).alias("first_word"),
            F.array_max(F.col("places.at")).alias("last_word"),
            F.array_distinct(F.col("places.label")).alias("base"),
        )
    )
    joined = rows.join(found, F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("text_hash") == F.col("found_hash")), "left")
    every = F.array_union("base", F.coalesce("found", F.array().cast("array<string>")))
    return joined.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(every), ",").alias("labels"),
        F.coalesce("score", F.lit(0.0)).cast("double").alias("score"),
    )


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def _phrase_sql(phrase: str, name: str) -> str:
    parts = phrase.split()
    here = " AND ".join(f"w[i + {d}] = '{part}'" for d, part in enumerate(parts))
    return f"SELECT k, i, '{name}' AS label FROM places WHERE {here}"


_NOTICE_SQL = ", ".join(f"('{name}', string_split('{text}', ' '))" for name, text in NOTICES.items())

OP10_SQL = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS k, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), places AS (
  SELECT k, w, unnest(range(1, len(w) + 1)) AS i FROM docs
), base AS (
  {" UNION ALL ".join(_phrase_sql(p, n) for p, n in BASE.items())}
), bases AS (
  SELECT k, count(*) AS n_base, min(i) - 1 AS first_word, max(i) - 1 AS last_word, list(DISTINCT label) AS labels FROM base GROUP BY k
), notices(notice, v) AS (VALUES {_NOTICE_SQL}
), grams AS (
  SELECT notice, len(v) AS n, v, unnest(range(1, len(v) - 1)) AS q FROM notices
), hits AS (
  SELECT p.k, g.notice, g.n, p.i - 1 AS p, g.q - 1 AS q
  FROM places p JOIN grams g ON p.w[p.i] = g.v[g.q] AND p.w[p.i + 1] = g.v[g.q + 1] AND p.w[p.i + 2] = g.v[g.q + 2]
), diagonals AS (
  SELECT k, notice, n, p - q AS d, p // n AS part, min(p) AS lo, max(p) AS hi, list(DISTINCT q) AS qs FROM hits GROUP BY ALL
), marked AS (
  SELECT *, CASE WHEN lag(d) OVER o IS NULL OR abs(d - lag(d) OVER o) > 3 OR lo > lag(hi) OVER o + 6 THEN 1 ELSE 0 END AS new
  FROM diagonals WINDOW o AS (PARTITION BY k, notice ORDER BY lo, d)
), numbered AS (
  SELECT *, sum(new) OVER (PARTITION BY k, notice ORDER BY lo, d RANGE UNBOUNDED PRECEDING) AS copy FROM marked
), words AS (
  SELECT k, notice, n, copy, unnest(qs) AS q FROM numbered
), copies AS (
  SELECT k, notice, count(DISTINCT q + x.d) / n AS coverage FROM words, (VALUES (0), (1), (2)) x(d) GROUP BY k, notice, n, copy HAVING count(DISTINCT q + x.d) / n >= 0.6
), found AS (
  SELECT k, list(DISTINCT notice) AS labels, max(coverage) AS score FROM copies GROUP BY k
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(array_to_string(list_sort(b.labels), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(f.labels, [])))), ','), '') AS labels,
       CAST(coalesce(f.score, 0) AS DOUBLE) AS score
FROM docs LEFT JOIN bases b USING (k) LEFT JOIN found f USING (k)
"""
