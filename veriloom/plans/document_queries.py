"""Queries on the shape of documents and on cached classifications (F, G, J, P, V, D)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import judge, sequential, windows
from .registry import query, read


@query(r"""WITH d AS (SELECT doc_id, 'Head line' || chr(10) || 'Introduction' || chr(10) || text || chr(10) || 'References' || chr(10) || '1. Old.' AS body FROM documents), l AS (SELECT doc_id, unnest(string_split(body, chr(10))) AS line, unnest(range(len(string_split(body, chr(10))))) AS k FROM d),
  m AS (SELECT doc_id, min(k) FILTER (lower(trim(line)) = 'introduction' AND k < 150) AS lo, max(k) FILTER (regexp_matches(trim(line), '(?i)^(references|bibliography|works cited)$')) AS hi FROM l GROUP BY 1)
  SELECT l.doc_id, count(*) AS lines, sum(length(line)) AS chars FROM l JOIN m USING (doc_id) WHERE k > coalesce(lo, -1) AND k < coalesce(hi, 1000000000) GROUP BY 1""")
def g17_body_trim(spark, sf_dir):
    """The lines after the Introduction heading and before the last heading of references."""
    body = F.concat(F.lit("Head line\nIntroduction\n"), "text", F.lit("\nReferences\n1. Old."))
    lines = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(body, "\n")).alias("k", "line"))
    by_doc = Window.partitionBy("doc_id")
    lo = F.min(F.when((F.lower(F.trim("line")) == "introduction") & (F.col("k") < 150), F.col("k"))).over(by_doc)
    hi = F.max(F.when(F.trim("line").rlike(r"(?i)^(references|bibliography|works cited)$"), F.col("k"))).over(by_doc)
    kept = lines.withColumn("lo", lo).withColumn("hi", hi).where((F.col("k") > F.coalesce("lo", F.lit(-1))) & (F.col("k") < F.coalesce("hi", F.lit(1_000_000_000))))
    return kept.groupBy("doc_id").agg(F.count("*").alias("lines"), F.sum(F.length("line")).alias("chars"))


@query("SELECT s_suppkey, n AS number, 'Author ' || n || ', Title of ' || s_name || ' (' || (1990 + n) || ')' AS entry, CAST(1990 + n AS VARCHAR) AS year, CASE WHEN n = 2 THEN '10.1234/x' || s_suppkey ELSE '' END AS doi FROM (SELECT s_suppkey, s_name, unnest([1, 2, 3]) AS n FROM supplier)")
def g19_d23_reference_entries(spark, sf_dir):
    """A reference list split at its numbers; year and DOI of each entry."""
    name = F.col("s_name")
    entry = lambda n, tail: F.concat(F.lit(f"\n{n}. Author {n}, Title of "), name, F.lit(f" ({1990 + n}){tail}"))
    blob = F.concat(F.lit("References"), entry(1, ""), entry(2, " doi:10.1234/x"), F.col("s_suppkey").cast("string"), entry(3, ""))
    parts = F.split(F.regexp_replace(blob, r"\n(\d{1,3})\. ", f"{t.MARK}$1{t.MARK}"), t.MARK)
    rows = read(spark, sf_dir, "supplier").select("s_suppkey", F.slice(parts, 2, F.size(parts)).alias("p"))
    rows = rows.select("s_suppkey", "p", F.explode(F.sequence(F.lit(0), (F.size("p") / 2 - 1).cast("int"))).alias("k"))
    text = F.substring(F.get("p", 2 * F.col("k") + 1), 1, 500)
    return rows.select("s_suppkey", F.get("p", 2 * F.col("k")).cast("int").alias("number"), F.trim(F.regexp_replace(text, r"\s*doi:\S+", "")).alias("entry"), F.regexp_extract(text, r"\(((?:19|20)\d{2})", 1).alias("year"), t.doi_in(text).alias("doi"))


@query("""WITH a AS (SELECT p_partkey AS id, p_partkey % 40 AS doi, list_distinct(string_split(lower(p_name), ' ')) AS w, p_size AS year FROM part WHERE p_partkey % 2 = 0), b AS (SELECT p_partkey AS id, p_partkey % 90 AS doi, list_distinct(string_split(lower(p_name), ' ')) AS w, p_size AS year FROM part WHERE p_partkey % 2 = 1)
  SELECT id FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.doi = b.doi) AND NOT EXISTS (SELECT 1 FROM a WHERE a.year = b.year AND len(list_intersect(a.w, b.w)) >= 0.7 * greatest(len(a.w), len(b.w)))""")
def j11_registry_only_union(spark, sf_dir):
    """Entries of a second list that the first lacks: another DOI, and no title of the same year that mostly agrees."""
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("year"), F.array_distinct(F.split(F.lower("p_name"), " ")).alias("w"))
    a, b = p.where("id % 2 = 0").withColumn("doi", F.col("id") % 40), p.where("id % 2 = 1").withColumn("doi", F.col("id") % 90)
    by_doi = b.join(a.select("doi").distinct(), "doi", "left_anti")
    known = a.select("year", F.col("w").alias("wa"))
    alike = F.size(F.array_intersect("wa", "w")) >= 0.7 * F.greatest(F.size("wa"), F.size("w"))
    return by_doi.alias("b").join(known.alias("a"), (F.col("a.year") == F.col("b.year")) & alike, "left_anti").select("id")


@query("SELECT item_id, item_id % 3 <> 0 AS echo FROM benchmark")
def p11_claim_echo(spark, sf_dir):
    """An extraction that is part of the claim, or nearly the claim, echoes it."""
    k = F.col("item_id") % 3
    claim = t.norm(F.col("text"))
    extracted = F.when(k == 1, F.substring(claim, 5, 60)).when(k == 2, F.concat(claim, F.lit(" x"))).otherwise(F.lit("0123 4567 89"))
    rows = read(spark, sf_dir, "benchmark").select("item_id", claim.alias("claim"), extracted.alias("e"))
    return rows.select("item_id", (F.contains("claim", F.col("e")) | (sequential.sequence_ratio("e", "claim") >= 0.85)).alias("echo"))


@query(r"""SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(x, '\b(?:1[6-9]|20)\d{2}\b'))), ',') AS years, array_to_string(list_sort(list_distinct(regexp_extract_all(x, '\d+(?:\.\d+)?%'))), ',') AS percents FROM (SELECT doc_id, text || ' In ' || (1900 + doc_id % 150) || ' it was ' || (doc_id % 40) || '.5% of ' || (doc_id % 40) || '.5%.' AS x FROM documents)""")
def f17_named_figures(spark, sf_dir):
    """Years from 1600 to 2099 and percentages that a text names, each once."""
    k = F.col("doc_id")
    x = F.concat("text", F.lit(" In "), 1900 + k % 150, F.lit(" it was "), k % 40, F.lit(".5% of "), k % 40, F.lit(".5%."))
    years, percents = t.extract_all(x, r"\b(?:1[6-9]|20)\d{2}\b"), t.extract_all(x, r"\d+(?:\.\d+)?%")
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_sort(F.array_distinct(years)), ",").alias("years"), F.array_join(F.array_sort(F.array_distinct(percents)), ",").alias("percents"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'opinion' WHEN event_type = 'click' THEN 'structural' WHEN event_type = 'view' THEN 'fact' ELSE '' END AS kind, event_id % 3 = 0 AS cached FROM events")
def v12_v13_cached_classification(spark, sf_dir):
    """A class from the cache of the same prompt and model, else from the provider; what is no class is null and not cached."""
    e = read(spark, sf_dir, "events")
    prompts = e.select("event_id", F.lit("m").alias("model"), F.sha1(F.col("event_id").cast("string")).alias("prompt_sha"), F.lit(1).alias("vote_no"), F.col("event_type").alias("prompt"))
    cache = prompts.where("event_id % 3 = 0").select("model", "prompt_sha", "vote_no", F.lit('{"kind": "opinion"}').alias("raw"))

    def provider(texts):
        answers = {"click": '{"kind": "structural"}', "view": '{"kind": "fact"}'}
        return (answers.get(x, '{"kind": "nonsense"}') for x in texts)

    raw = judge.enrich(prompts.drop("event_id"), cache, provider)
    kind = F.get_json_object(judge.tolerant_json(F.col("raw")), "$.kind")
    rows = prompts.select("event_id", "prompt_sha").join(raw, "prompt_sha")
    return rows.select("event_id", F.when(kind.isin("structural", "opinion", "fact"), kind).otherwise("").alias("kind"), (F.col("event_id") % 3 == 0).alias("cached"))


@query("SELECT conv_id, turn, string_agg(text, ' ') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS wide FROM conversations")
def v23_wide_windows(spark, sf_dir):
    """The windows that a second reading gets: four turns on either side."""
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", windows.around("text", "conv_id", "turn", 4).alias("wide"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS src, o_orderkey AS dst, (o_orderkey % 100) / 100.0 AS conf FROM orders), c AS (SELECT src, dst, max(conf) AS conf FROM e GROUP BY 1, 2), b AS (SELECT src, arg_max(dst, (conf, -dst)) AS dst, max(conf) AS conf FROM c GROUP BY 1),
  w AS (SELECT src AS claim, src AS spot, 0 AS depth FROM b UNION ALL SELECT w.claim, b.dst, w.depth + 1 FROM w JOIN b ON b.src = w.spot WHERE w.depth < 2 AND b.conf >= 0.55)
  SELECT claim, arg_max(spot, depth) AS origin, max(depth) AS hops FROM w GROUP BY 1""")
def d22_origin_trace(spark, sf_dir):
    """From each cited source at most two attributed steps back, stopping where the attribution is not confident."""
    return _origins(read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"), ((F.col("o_orderkey") % 100) / 100.0).alias("conf")))


def _origins(o):
    best = o.groupBy("src").agg(F.max_by(F.struct("dst", "conf"), F.struct("conf", (-F.col("dst")).alias("d"))).alias("b")).select("src", "b.*").where("conf >= 0.55")
    now = o.select(F.col("src").alias("claim"), F.col("src").alias("origin")).distinct().withColumn("hops", F.lit(0))
    for hop in range(2):
        step = best.select(F.col("src").alias("origin"), F.col("dst").alias("next"))
        fresh = F.col("hops") == F.lit(hop)
        now = now.join(step, "origin", "left").select("claim", F.when(fresh & F.col("next").isNotNull(), F.col("next")).otherwise(F.col("origin")).alias("origin"), F.when(fresh & F.col("next").isNotNull(), F.col("hops") + 1).otherwise(F.col("hops")).alias("hops"))
    return now
