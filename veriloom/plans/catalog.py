"""Every registered query of the library with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import assembly_queries, chain_queries, document_queries, evidence_queries, extension_queries, judging_queries, retrieval_queries, sequence_queries, text_queries  # noqa: F401
from .registry import QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, (query, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["r08_r09_r10_w04_hybrid_topk"][0](spark, sf_dir)
