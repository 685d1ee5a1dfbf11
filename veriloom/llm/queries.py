"""The registered queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, exact_dedup, html_text, jaccard_join, langid, packing, pii, sharding, suffix_dedup, warc
from .common import table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_groups(table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("starts", "ends")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.learn(docs))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = warc.archive_round_trip(table(spark, sf_dir, "pages"))
    return got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_jaccard_join, op2_suffix_dedup, op3_language_id, op4_decontamination, op5_html_text, op6_sharding, op7_pii, op8_packing, op9_exact_dedup, op10_warc)
    return {f.__name__: f for f in found}


OP6 = f"""
WITH RECURSIVE names AS (
  SELECT i AS shard, 'shard-' || lpad(CAST(i AS VARCHAR), 3, '0') AS name FROM range({sharding.SHARDS}) t(i)
), prefs AS (
  SELECT shard, list((start + j * skip) % {sharding.SLOTS} ORDER BY j) AS wish
  FROM (SELECT shard,
    CAST('0x' || substr(md5(name || ':offset'), 1, 15) AS BIGINT) % {sharding.SLOTS} AS start,
    CAST('0x' || substr(md5(name || ':skip'), 1, 15) AS BIGINT) % {sharding.SLOTS - 1} + 1 AS skip
  FROM names), range({sharding.SLOTS}) r(j)
  GROUP BY shard
), claims AS (
  SELECT 0 AS turn, CAST(repeat('0', {sharding.SLOTS}) AS BITSTRING) AS taken, CAST(NULL AS INTEGER) AS slot, CAST(NULL AS INTEGER) AS shard
  UNION ALL
  SELECT turn + 1, set_bit(taken, found, 1), found, owner
  FROM (
    SELECT c.turn, c.taken, CAST(p.shard AS INTEGER) AS owner,
      CAST(list_filter(p.wish, lambda s: get_bit(c.taken, CAST(s AS INTEGER)) = 0)[1] AS INTEGER) AS found
    FROM claims c JOIN prefs p ON p.shard = c.turn % {sharding.SHARDS}
    WHERE c.turn < {sharding.SLOTS}
  )
), placed AS (
  SELECT doc_id, CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {sharding.SLOTS} AS INTEGER) AS slot FROM documents
)
SELECT p.doc_id, p.slot, c.shard FROM placed p JOIN claims c ON c.slot = p.slot
"""

OP9 = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS points, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id,
  first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id,
  count(*) OVER (PARTITION BY text_sha256) AS group_size,
  doc_id = first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS kept,
  text_sha256
FROM n
"""

OP10 = """
WITH n AS (SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS digest, CAST(strlen(coalesce(html, '')) AS BIGINT) AS bytes FROM pages),
g AS (SELECT *, CASE WHEN bytes >= 100 THEN min(page_id) OVER (PARTITION BY digest) ELSE page_id END AS first FROM n)
SELECT page_id, bytes AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM g
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_sharding": OP6, "op9_exact_dedup": OP9, "op10_warc": OP10}
