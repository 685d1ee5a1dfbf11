"""The corpus pipeline: language, exact copies, near copies, benchmark passages, packing.

Each stage takes the Parquet its predecessor wrote. All but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veriloom.llm import decontaminate, exact_dedup, jaccard_join, langid, packing
from veriloom.llm.common import materialize, small_batches, table
from veriloom.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(docs: DataFrame) -> DataFrame:
    """The stages' columns; each stage gives null texts, ties, repeated rows and empty tables what its operator does."""
    small_batches(docs.sparkSession)
    return docs.select(COLUMNS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a language (null, empty, no letter) go; the model learns from this stage's own labelled rows."""
    docs = _documents(docs)
    return langid.keep_identified(docs, langid.learn(docs))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the longest as written stays, then the least doc_id."""
    return exact_dedup.drop_copies(_documents(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of texts linked by a similarity of 0.8 on five-word shingles the least doc_id stays."""
    return jaccard_join.drop_similar(_documents(docs))


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.drop_contaminated(_documents(docs), table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents that are left, in windows of 2048 tokens."""
    return packing.pack(_documents(docs), tokenizer_path())


STAGES = [
    ("language", identify_language),
    ("exact_copies", drop_exact_copies),
    ("near_copies", drop_near_copies),
    ("benchmark_passages", drop_benchmark_passages),
    ("packing", pack_sequences),
]

#: No SQL expresses the learned language model and the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each but the last written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
