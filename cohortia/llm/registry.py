"""Queries of the corpus operators and, where SQL can express them, the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann_hnsw, corpus_sql, decontaminate, license_scan, near_dup, packing, prefix_join, prefix_trie, quality_crf, sharding, structure_repair, substring_dedup, url_filter, warc


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": quality_crf.op1_quality,
        "op2_pack": packing.op2_pack,
        "op3_nearest": ann_hnsw.op3_nearest,
        "op4_warc": warc.op4_warc,
        "op5_near_duplicates": near_dup.op5_near_duplicates,
        "op6_repeats": substring_dedup.op6_repeats,
        "op7_jump_shards": sharding.op7_jump_shards,
        "op8_decontaminate": decontaminate.op8_decontaminate,
        "op9_url_verdicts": url_filter.op9_url_verdicts,
        "op10_license_scan": license_scan.op10_license_scan,
        "op11_prefix_trie": prefix_trie.op11_prefix_trie,
        "op12_structure_repair": structure_repair.op12_structure_repair,
        "op13_prefix_join": prefix_join.op13_prefix_join,
        "pipeline": _pipeline,
    }


def oracles() -> dict[str, str]:
    return {
        "op4_warc": corpus_sql.OP4,
        "op5_near_duplicates": corpus_sql.OP5,
        "op6_repeats": corpus_sql.OP6,
        "op8_decontaminate": corpus_sql.OP8,
        "op9_url_verdicts": url_filter.OP9_SQL,
        "op10_license_scan": license_scan.OP10_SQL,
        "op11_prefix_trie": prefix_trie.OP11_SQL,
        "op12_structure_repair": structure_repair.OP12_SQL,
        "op13_prefix_join": corpus_sql.OP13,
    }
