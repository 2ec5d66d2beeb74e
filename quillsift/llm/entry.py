"""Queries of the corpus operators, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillsift.llm import byte_cnn, jaccard, line_dedup, mixing, packing, quality_rules, secret_scan, suffix_dedup, topk, toxicity
from quillsift.llm.common import documents


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Query name to callable (spark, sf_dir)."""
    return {
        "op1_topk": lambda spark, d: topk.query(spark.read.parquet(f"{d}/embeddings.parquet")),
        "op2_toxicity": lambda spark, d: toxicity.query(documents(spark, d), _labels(spark, d)),
        "op3_secret_scan": lambda spark, d: secret_scan.query(documents(spark, d)),
        "op4_packing": lambda spark, d: packing.query(documents(spark, d)),
        "op5_mixing": lambda spark, d: mixing.query(documents(spark, d)),
        "op6_line_dedup": lambda spark, d: line_dedup.query(documents(spark, d)),
        "op7_byte_cnn": lambda spark, d: byte_cnn.query(documents(spark, d), _labels(spark, d)),
        "op8_quality_rules": lambda spark, d: quality_rules.query(documents(spark, d)),
        "op10_jaccard": lambda spark, d: jaccard.query(documents(spark, d)),
        "op9_suffix_dedup": lambda spark, d: suffix_dedup.query(documents(spark, d)),
    }


def oracle_sql() -> dict[str, str]:
    """Query name to DuckDB SQL."""
    return {"op1_topk": topk.ORACLE, "op6_line_dedup": line_dedup.ORACLE, "op8_quality_rules": quality_rules.ORACLE, "op10_jaccard": jaccard.ORACLE}
