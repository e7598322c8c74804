"""From raw documents to packed training sequences.

STAGES: (name, function) in order. Each function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and read again as the next one's ``docs``; all but the
last return the columns of ``documents``. Every stage works on all that its predecessor kept.

Cases, for every stage: null and empty texts are documents without words, which only the first
stage judges; rows with a null doc_id stay documents; other columns may hold nulls and have any
name; an empty table gives no rows. Repeated rows are kept or dropped alike, but the second stage
keeps one of them; a doc_id with several texts is several documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortia.llm.common import table, written
from cohortia.llm.decontaminate import drop_contaminated
from cohortia.llm.near_dup import drop_near_duplicates
from cohortia.llm.packing import pack
from cohortia.llm.quality_crf import keep_good
from cohortia.llm.substring_dedup import cut_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked at 0.8 over five-word shingles, the one of the smallest doc_id stays;
    rows without a doc_id or words are linked with nothing. Ties can't be: texts of equal doc_id
    are told apart."""
    return drop_near_duplicates(docs, shingle=5, percent=80)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 100 bytes or more that stand earlier in the corpus are cut out."""
    return cut_repeats(docs)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens, with their ids."""
    return pack(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeats", repeats),
    ("benchmarks", benchmarks),
    ("packing", packing),
]

#: The first stage's trained scores and the last one's tokens can't be stated in SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
