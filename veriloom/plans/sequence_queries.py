"""Queries of folds, greedy choices, citations, sinks and streams (G, J, I, C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import sequential
from ..sources import bibliography
from ..streaming import verdicts
from .registry import query, read
from .retrieval_queries import similar_pairs
from .text_queries import SENTENCES, sentence_rows


@query(rf"""WITH RECURSIVE s AS (SELECT doc_id, list(CAST(len(string_split(text, ' ')) AS INTEGER) ORDER BY j) AS n FROM {SENTENCES} GROUP BY doc_id),
  f AS (SELECT doc_id, 0 AS j, 0 AS chunk, n[1] AS total, n FROM s UNION ALL SELECT doc_id, j + 1, CASE WHEN total >= 200 THEN chunk + 1 ELSE chunk END, CASE WHEN total >= 200 THEN n[j + 2] ELSE total + n[j + 2] END, n FROM f WHERE j + 1 < len(n))
  SELECT doc_id, j, chunk FROM f""")
def g09_sentence_chunks(spark, sf_dir):
    rows = sentence_rows(read(spark, sf_dir, "documents"))
    counts = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("j", F.size(F.split("text", " ")).alias("n")))).alias("s"))
    return counts.select("doc_id", F.posexplode(sequential.chunk_numbers(F.col("s.n"), 200)).alias("j", "chunk"))


@query(r"""WITH RECURSIVE s AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda y: CAST(len(list_filter(string_split(trim(regexp_replace(y, '\s+', ' ', 'g')), ' '), lambda x: x <> '')) AS INTEGER)) AS n FROM documents),
  f AS (SELECT doc_id, 0 AS k, 0 AS chunk, n[1] AS total, n FROM s UNION ALL SELECT doc_id, k + 1, CASE WHEN total > 0 AND total + n[k + 2] > 150 THEN chunk + 1 ELSE chunk END, CASE WHEN total > 0 AND total + n[k + 2] > 150 THEN n[k + 2] ELSE total + n[k + 2] END, n FROM f WHERE k + 1 < len(n))
  SELECT doc_id, k, chunk FROM f""")
def g10_paragraph_chunks(spark, sf_dir):
    counts = F.transform(F.split("text", "\n"), lambda x: F.size(t.words(x)))
    return read(spark, sf_dir, "documents").select("doc_id", F.posexplode(sequential.paragraph_chunks(counts, 150)).alias("k", "chunk"))


@query()
def g06_g07_source_sentences(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", sequential.source_sentences("text").alias("s"))
    return rows.select("doc_id", F.posexplode("s").alias("j", "text"))


@query()
def j06_greedy_pairs(spark, sf_dir):
    scored = similar_pairs(read(spark, sf_dir, "embeddings"), 0.35).withColumn("cos", F.round("cos", 9))
    return sequential.greedy_pairs(scored, 2)


@query()
def j09_f14_fuzzy_rematch(spark, sf_dir):
    """Conversation turns of two versions, the second with its first word changed, matched within a conversation."""
    c = read(spark, sf_dir, "conversations").where("text is not null")
    left = c.select("conv_id", F.col("turn").alias("new_id"), "text", F.col("role").alias("markers"))
    right = c.where("turn % 2 = 0").select("conv_id", F.col("turn").alias("old_id"), F.regexp_replace("text", r"^\S+", "Edited").alias("text"), F.col("role").alias("markers"))
    return sequential.fuzzy_rematch(left, right, "conv_id")


@query()
def f15_v21_quote_integrity(spark, sf_dir):
    """Quotes that no text under the same key holds to 85 percent."""
    quotes = read(spark, sf_dir, "benchmark").select("item_id", t.norm(F.col("text")).alias("quote"), (F.col("item_id") % 40).alias("src"))
    docs = read(spark, sf_dir, "documents").select((F.col("doc_id") % 40).alias("src"), t.norm(F.col("text")).alias("body"))
    scored = quotes.join(docs, "src").select("item_id", sequential.longest_block("quote", "body").alias("score"))
    return scored.groupBy("item_id").agg(F.round(F.max("score"), 6).alias("best")).where("best < 0.85")


@query("""WITH b AS (SELECT c_custkey AS ord, 'smith' || (c_custkey % 20) AS base, CAST(1990 + c_custkey % 5 AS VARCHAR) AS y FROM customer), k AS (SELECT ord, regexp_replace(base, '[^a-z]', '', 'g') || y AS base FROM b), n AS (SELECT ord, base, row_number() OVER (PARTITION BY base ORDER BY ord) AS n FROM k)
  SELECT ord, CASE WHEN n = 1 THEN base ELSE base || '_' || n END AS key FROM n""")
def f25_citation_keys(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    rows = c.select(F.col("c_custkey").alias("ord"), F.concat(F.lit("smith"), F.col("c_custkey") % 20).alias("surname"), (1990 + F.col("c_custkey") % 5).cast("string").alias("year"), F.col("c_name").alias("title"))
    return sequential.mint_keys(rows).select("ord", "key")


@query(r"""SELECT p AS doc_id, string_agg(CAST(n AS VARCHAR), ',' ORDER BY n) AS cited FROM (SELECT DISTINCT doc_id AS p, unnest([doc_id % 30 + 1, doc_id % 30 + 3, doc_id % 30 + 4, doc_id % 30 + 5]) AS n FROM documents) GROUP BY p""")
def g16_numeric_citations(spark, sf_dir):
    n = F.col("doc_id") % 30
    text = F.concat(F.lit("As shown ["), n + 1, F.lit(", "), n + 3, F.lit("-"), n + 5, F.lit("] and [9-2]."))
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_sort(F.array_distinct(bibliography.numeric_citations(text))), ",").alias("cited"))


@query("SELECT doc_id, 'key' || (doc_id % 7) || ',' || lang || '_' || (doc_id % 3) AS keys FROM documents")
def g14_pandoc_citations(spark, sf_dir):
    text = F.concat(F.lit("Known [@key"), F.col("doc_id") % 7, F.lit("; @"), "lang", F.lit("_"), F.col("doc_id") % 3, F.lit(", p. 3] and [@key"), F.col("doc_id") % 7, F.lit("]."))
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(bibliography.pandoc_keys(text), ",").alias("keys"))


@query("SELECT doc_id, source AS title, md5(text) AS body FROM documents")
def c02_front_matter(spark, sf_dir):
    title, body = bibliography.front_matter(F.concat(F.lit("﻿---\ntitle: \""), "source", F.lit("\"\nlang: en\n---\n"), "text"))
    return read(spark, sf_dir, "documents").select("doc_id", title.alias("title"), F.md5(body).alias("body"))


@query("SELECT n_regionkey AS text_id, 'k' || (n_nationkey % 3) AS name, arg_max(n_name || '.pdf', n_nationkey) AS filename FROM nation GROUP BY 1, 2")
def c03_reference_map(spark, sf_dir):
    line = F.concat(F.lit(" k"), F.col("n_nationkey") % 3, F.lit(" = "), "n_name", F.lit(".pdf"))
    parts = read(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("text_id")).agg(F.array_sort(F.collect_list(F.struct("n_nationkey", line.alias("l")))).alias("s"))
    texts = parts.select("text_id", F.concat(F.lit("# comment = x\n\n"), F.array_join("s.l", "\n")).alias("refs"))
    return bibliography.reference_map(texts, "text_id")


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def streaming_hourly_counts(spark, sf_dir):
    got = verdicts.run_once(verdicts.hourly_counts(verdicts.events(spark, sf_dir)), "complete")
    return got.select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "event_type", "n")


@query("SELECT user_id, arg_max(event_type, struct_pack(t := ts, e := event_id)) AS verdict, max(event_id) AS events_to FROM events GROUP BY 1")
def streaming_last_verdicts(spark, sf_dir):
    return verdicts.run_once(verdicts.last_verdicts(verdicts.events(spark, sf_dir)), "complete")


@query("SELECT event_id, event_type FROM events")
def streaming_delivered_once(spark, sf_dir):
    return verdicts.run_once(verdicts.delivered_once(verdicts.events(spark, sf_dir)).select("event_id", "event_type"), "append")


@query("""SELECT event_id AS claim, '{"id":' || event_id || ',"verdict":"' || event_type || '"' || CASE WHEN event_id % 2 = 0 THEN ',"user":' || user_id ELSE '' END || '}' AS record FROM events""")
def c18_c20_n08_json_export(spark, sf_dir):
    """One JSON record a claim; null fields are left out."""
    user = F.when(F.col("event_id") % 2 == 0, F.col("user_id"))
    record = F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("verdict"), user.alias("user")), {"ignoreNullFields": "true"})
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("claim"), record.alias("record"))
