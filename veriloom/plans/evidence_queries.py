"""Queries of gates, locations, bibliographies and caches (F, P, G, J, D, C, N, V)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import evidence, judge
from .registry import query, read
from .text_queries import SENTENCES, sentence_rows


@query("SELECT doc_id, md5(strip_accents(lower(text))) AS folded FROM documents")
def f05_f06_folds(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(evidence.fold("text")).alias("folded"))


@query("""WITH x AS (SELECT o_orderkey, date_part('year', o_orderdate) AS y, date_part('month', o_orderdate) AS m, date_part('day', o_orderdate) AS d FROM orders)
  SELECT o_orderkey, y || '-' || lpad(CAST(m AS VARCHAR), 2, '0') || '-' || lpad(CAST(d AS VARCHAR), 2, '0') AS found FROM x""")
def f20_written_dates(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    d = F.col("o_orderdate")
    line = F.when(F.col("o_orderkey") % 3 == 0, F.date_format(d, "'Published 'd MMM yyyy")).when(F.col("o_orderkey") % 3 == 1, F.date_format(d, "MMMM d, yyyy")).otherwise(F.date_format(d, "'Updated 'yyyy-MM-dd"))
    return o.select("o_orderkey", evidence.written_date(line).alias("found"))


@query("SELECT c_custkey AS src, CASE WHEN c_custkey % 3 = 0 THEN c_name || ' (byline: Ann Lee' || CASE WHEN c_custkey % 2 = 0 THEN '; article dated 2020-01-02' ELSE '' END || ')' WHEN c_custkey % 2 = 0 THEN c_name || ' (article dated 2020-01-02)' ELSE c_name END AS label FROM customer")
def f21_f22_source_labels(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("src"), "c_name")
    first = F.when(F.col("src") % 3 == 0, "Author: Ann Lee").otherwise("An author: nobody knows who this person is")
    lines = c.select("src", F.explode(F.array(F.struct(F.lit(3).alias("j"), F.lit("Author: Later Name").alias("text")), F.struct(F.lit(1).alias("j"), first.alias("text")))).alias("s")).select("src", "s.*").where("src % 3 = 0 or j = 1")
    named = c.join(evidence.author_byline(lines, "src"), "src", "left")
    return named.select("src", evidence.source_label(F.col("c_name"), F.col("author"), F.when(F.col("src") % 2 == 0, "2020-01-02")).alias("label"))


@query("""SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN n_name || ' grew|the rate fell' WHEN 1 THEN n_name || ' exists' WHEN 2 THEN n_name || ' is large' ELSE '' END AS parts FROM nation""")
def f23_missing_parts(spark, sf_dir):
    k, n = F.col("n_nationkey") % 4, F.col("n_name")
    reason = F.when(k == 0, F.concat(F.lit("The passage does not state that "), n, F.lit(" grew, nor that the rate fell."))).when(k == 1, F.concat(F.lit("The claim that "), n, F.lit(" exists is not mentioned."))).when(k == 2, F.concat(F.lit("The passage contradicts the claim that "), n, F.lit(" is large, which is noted."))).otherwise("It is fine.")
    return read(spark, sf_dir, "nation").select("n_nationkey", F.array_join(evidence.missing_parts(reason), "|").alias("parts"))


@query("SELECT p_partkey, p_partkey % 4 < 3 AS present FROM part")
def f31_figure_presence(spark, sf_dir):
    k = F.col("p_partkey")
    figure = F.when(k % 4 == 0, F.concat(k, F.lit("%"))).when(k % 4 == 1, "29,615").when(k % 4 == 2, "1.42").otherwise(F.concat(k, F.lit("7")))
    text = F.when(k % 4 == 0, F.concat(F.lit("about "), k, F.lit(" % of"))).when(k % 4 == 1, F.lit("some 29 615 units")).when(k % 4 == 2, F.lit("ratio 1·42 here")).otherwise(F.concat(F.lit("no. "), k, F.lit("78")))
    return read(spark, sf_dir, "part").select("p_partkey", evidence.figure_present(figure, text).alias("present"))


PAGES = "pages AS (SELECT doc_id, k // 3 + 1 AS page, string_agg(line, ' ' ORDER BY k) AS page_text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS k FROM documents) GROUP BY 1, 2)"


@query(rf"""WITH {PAGES}, s AS (SELECT doc_id, j, lower(text) AS s, lower(array_to_string(list_slice(string_split(text, ' '), 1, 6), ' ')) AS pre FROM {SENTENCES}),
  h AS (SELECT doc_id, j, page, CASE WHEN contains(p, s) THEN 0 WHEN contains(p, pre) THEN 1 END AS rank FROM s JOIN (SELECT doc_id, page, lower(trim(regexp_replace(page_text, '\s+', ' ', 'g'))) AS p FROM pages) USING (doc_id))
  SELECT doc_id, j, arg_min(page, rank * 1000000 + page) AS page FROM h WHERE rank IS NOT NULL GROUP BY 1, 2""")
def g08_sentence_pages(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "line")).withColumn("page", (F.floor(F.col("k") / 3) + 1))
    pages = lines.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("k", "line"))).alias("l")).select("doc_id", "page", F.array_join("l.line", " ").alias("page_text"))
    return evidence.page_of(sentence_rows(docs), pages, "doc_id")


@query(rf"""SELECT doc_id, j, len(string_split(text, ' ')) AS n, (row_number() OVER (PARTITION BY doc_id ORDER BY j) - 1) // 40 AS batch FROM {SENTENCES}""")
def g20_g21_prompt_batches(spark, sf_dir):
    """The rows of each document in batches of forty."""
    rows = sentence_rows(read(spark, sf_dir, "documents")).select("doc_id", "j", F.size(F.split("text", " ")).cast("long").alias("n"))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("j")) - 1
    return rows.select("doc_id", "j", "n", F.floor(number / 40).alias("batch"))


@query("""SELECT doc_id, regexp_extract(text, '^(\\S+)', 1) <> '' AND doc_id % 3 = 0 AND length(regexp_replace(lower(text), '[^a-z0-9]+', '', 'g')) >= 0 AND len(list_filter(string_split(trim(regexp_replace(lower(substr(text, 1, 200)), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '')) >= 6 AS fragment FROM documents""")
def p12_claim_fragment(spark, sf_dir):
    """Every third extraction is the claim's own wording, which its source (the reversed text) does not hold."""
    docs = read(spark, sf_dir, "documents")
    claim = F.substring("text", 1, 200)
    source = F.when(F.col("doc_id") % 3 == 0, F.lit("something else entirely")).otherwise(F.col("text"))
    return docs.select("doc_id", evidence.unsourced_fragment(claim, claim, source).alias("fragment"))


@query("""SELECT s_suppkey, s_suppkey % 2 = 0 AS named, s_suppkey % 3 = 0 AS entity_ok FROM supplier""")
def p14_p19_entity_guard(spark, sf_dir):
    k = F.col("s_suppkey")
    claim = F.when(k % 2 == 0, F.lit("As Drago argues, it grew")).otherwise("As some argue, it grew")
    text = F.when(k % 3 == 0, F.lit("the world bank and nasa said")).otherwise("only nasa said")
    return read(spark, sf_dir, "supplier").select("s_suppkey", evidence.names_source(claim, F.lit("drago2025")).alias("named"), evidence.entities_named(F.array(F.lit("world bank"), F.lit("nasa esa")), text).alias("entity_ok"))


@query("""WITH k AS (SELECT 'k' || c_custkey AS key, CASE WHEN c_custkey % 2 = 0 THEN '10.1000/ab' || c_custkey ELSE '' END AS doi, CASE WHEN c_custkey % 3 = 0 THEN 'x.org/' || c_custkey ELSE '' END AS url, lower(c_name) AS title FROM customer),
  n AS (SELECT c_custkey AS id, '10.1000/ab' || (c_custkey + 2) AS doi, 'x.org/' || (c_custkey + 1) AS url, lower(c_name) || CASE WHEN c_custkey % 5 = 0 THEN ' x' ELSE '' END AS title FROM customer)
  SELECT n.id, coalesce(d.key, u.key, t.key, '') AS same_as FROM n LEFT JOIN k d ON d.doi = n.doi LEFT JOIN k u ON u.url = n.url LEFT JOIN (SELECT title, min(key) AS key FROM k GROUP BY 1) t ON t.title = n.title""")
def j10_p18_bibliography_merge(spark, sf_dir):
    """All customers against all customers, each with identifiers of its neighbours and some with another title."""
    k = F.col("c_custkey")
    c = read(spark, sf_dir, "customer")
    known = c.select(F.concat(F.lit("k"), k).alias("key"), F.when(k % 2 == 0, F.concat(F.lit("10.1000/AB"), k)).otherwise("").alias("doi"), F.when(k % 3 == 0, F.concat(F.lit("http://x.org/"), k)).otherwise("").alias("url"), F.col("c_name").alias("title"))
    title = F.concat("c_name", F.when(k % 5 == 0, " x").otherwise(""))
    new = c.select(k.alias("id"), F.concat(F.lit("10.1000/ab"), k + 2).alias("doi"), F.concat(F.lit("https://www.x.org/"), k + 1, F.lit("/")).alias("url"), title.alias("title"))
    return evidence.merge_bibliography(new, known).select("id", F.coalesce("same_as", F.lit("")).alias("same_as"))


@query("""WITH c AS (SELECT l_orderkey AS file, l_suppkey AS key, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN 2 ELSE 3 END AS tier FROM lineitem GROUP BY ALL), b AS (SELECT *, min(tier) OVER (PARTITION BY file) AS best FROM c)
  SELECT file, CASE WHEN count(*) = 1 THEN min(key) ELSE -1 END AS key, best AS tier, CASE WHEN count(*) = 1 THEN 'matched' ELSE 'ambiguous' END AS status FROM b WHERE tier = best GROUP BY file, best""")
def j14_j15_c16_tiered_match(spark, sf_dir):
    l = read(spark, sf_dir, "lineitem")
    tier = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "R", 2).otherwise(3)
    got = evidence.tiered_match(l.select(F.col("l_orderkey").alias("file"), F.col("l_suppkey").alias("key"), tier.alias("tier")), "file", "key")
    return got.withColumn("key", F.coalesce("key", F.lit(-1)))


@query("""WITH n AS (SELECT doc_id, md5(text) AS h FROM documents), c AS (SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'x' ELSE md5(text) END AS old, 8 - doc_id % 3 AS schema FROM documents WHERE doc_id % 10 <> 7)
  SELECT n.doc_id, CASE WHEN old IS NULL OR old <> h THEN 'read' WHEN schema < 8 THEN 'rebuild_sentences' ELSE 'hit' END AS action FROM n LEFT JOIN c USING (doc_id)""")
def c12_i05_source_cache(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    cache = d.where("doc_id % 10 <> 7").select("doc_id", F.when(F.col("doc_id") % 6 == 0, "x").otherwise(F.md5("text")).alias("old"), (8 - F.col("doc_id") % 3).alias("schema"))
    rows = d.select("doc_id", F.md5("text").alias("h")).join(cache, "doc_id", "left")
    return rows.select("doc_id", F.when(F.col("old").isNull() | (F.col("old") != F.col("h")), "read").when(F.col("schema") < 8, "rebuild_sentences").otherwise("hit").alias("action"))


@query("SELECT s_suppkey AS a, s_suppkey % 7 AS b, CASE WHEN s_suppkey % 4 = 0 THEN 'none' WHEN s_suppkey % 4 = 1 THEN 'strong' WHEN s_suppkey % 4 = 2 THEN 'weak' ELSE 'unknown' END AS level FROM supplier")
def d13_shared_authors(spark, sf_dir):
    """Known ids decide: shared is strong, disjoint is none; else shared surnames are weak; else unknown."""
    k = F.col("s_suppkey")
    ids_a, ids_b = F.when(k % 4 < 2, F.array(F.lit(1), F.lit(2))), F.when(k % 4 == 0, F.array(F.lit(3))).when(k % 4 == 1, F.array(F.lit(2)))
    names_a, names_b = F.array(F.lit("lee"), F.lit("roy")), F.when(k % 4 == 3, F.array(F.lit("poe"))).otherwise(F.array(F.lit("lee")))
    level = F.when(ids_a.isNotNull() & ids_b.isNotNull(), F.when(F.arrays_overlap(ids_a, ids_b), "strong").otherwise("none")).when(F.arrays_overlap(names_a, names_b), "weak").otherwise("unknown")
    return read(spark, sf_dir, "supplier").select(k.alias("a"), (k % 7).alias("b"), level.alias("level"))


@query("""WITH m AS (SELECT DISTINCT vec_id % 60 AS cluster, label AS src FROM embeddings WHERE vec_id % 4 <> 0), n AS (SELECT label AS src, count(*) AS n FROM embeddings GROUP BY 1), x AS (SELECT a.src AS a, b.src AS b, count(*) AS shared FROM m a JOIN m b ON a.cluster = b.cluster AND a.src < b.src GROUP BY 1, 2)
  SELECT a, b, shared, round(least(1.0, shared / least(na.n, nb.n)), 6) AS share, CASE WHEN shared / least(na.n, nb.n) >= 0.3 THEN 'strong' WHEN shared / least(na.n, nb.n) >= 0.1 THEN 'weak' ELSE 'none' END AS level FROM x JOIN n na ON na.src = a JOIN n nb ON nb.src = b""")
def d16_content_overlap(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    m = e.where("vec_id % 4 <> 0").select((F.col("vec_id") % 60).alias("cluster"), F.col("label").alias("src")).distinct()
    n = e.groupBy(F.col("label").alias("src")).agg(F.count("*").alias("n"))
    x = m.select("cluster", F.col("src").alias("a")).join(m.select("cluster", F.col("src").alias("b")), "cluster").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    x = x.join(n.select(F.col("src").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("src").alias("b"), F.col("n").alias("nb")), "b")
    share = F.col("shared") / F.least("na", "nb")
    return x.select("a", "b", "shared", F.round(F.least(F.lit(1.0), share), 6).alias("share"), F.when(share >= 0.3, "strong").when(share >= 0.1, "weak").otherwise("none").alias("level"))


@query()
def d20_snowball(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    cites = o.select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst")).where("src <> dst").distinct()
    papers = o.groupBy(F.col("o_orderkey").alias("paper")).agg(F.round(F.max("o_totalprice"), 2).alias("relevance"))
    got = evidence.snowball(papers, cites, papers.where("paper < 3"))
    return got.select("paper", "level", F.array_join("found_via", ">").alias("found_via"))


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 5 WHEN event_id % 5 = 1 THEN 3 WHEN event_id % 5 = 4 THEN 9 ELSE -1 END AS pick, 'First whole sentence here.|Second whole sentence is here.' AS sentences FROM events""")
def n03_n04_salvage_and_picks(spark, sf_dir):
    k = F.col("event_id") % 5
    raw = F.when(k == 0, "5").when(k == 1, "[3]").when(k == 2, "x").when(k == 3, "77").otherwise(" 9 ")
    answer = F.when(k < 3, '{"sentences": ["First whole sentence here.", "Second whole sentence is here."]}').otherwise('{"sentences": ["First whole sentence here.", "Second whole sentence is here.", "cut')
    return read(spark, sf_dir, "events").select("event_id", F.coalesce(judge.pick(raw, 12), F.lit(-1)).alias("pick"), F.array_join(judge.parse_sentences(answer), "|").alias("sentences"))


@query("""WITH r AS (SELECT event_id, CASE WHEN event_id % 50 = 7 THEN event_id - 1 ELSE event_id END AS id, event_id % 9 = 2 AS no_claim, event_id % 11 = 3 AS bad_flag FROM events), n AS (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM r)
  SELECT event_id, concat_ws(',', CASE WHEN no_claim THEN 'claim missing' END, CASE WHEN bad_flag THEN 'human_ok' END, CASE WHEN n > 1 THEN 'repeated id' END) AS errors FROM n""")
def n06_jsonl_validator(spark, sf_dir):
    """Rows of a JSON Lines file checked for required keys, allowed values and unique ids."""
    e = read(spark, sf_dir, "events")
    k = F.col("event_id")
    record = F.struct(F.when(k % 50 == 7, k - 1).otherwise(k).alias("claim_id"), F.when(k % 9 != 2, F.lit("c")).alias("claim"), F.when(k % 11 == 3, "maybe").when(k % 2 == 0, "y").alias("human_ok"))
    rows = e.select("event_id", F.to_json(record).alias("line")).withColumn("r", F.from_json("line", "claim_id long, claim string, human_ok string"))
    n = F.count("*").over(Window.partitionBy("r.claim_id"))
    errors = F.concat_ws(",", F.when(F.coalesce("r.claim", F.lit("")) == "", "claim missing"), F.when(~F.coalesce(F.col("r.human_ok").isin("y", "n"), F.lit(True)), "human_ok"), F.when(n > 1, "repeated id"))
    return rows.select("event_id", errors.alias("errors"))


@query("""SELECT doc_id, CASE WHEN doc_id % 4 < 2 THEN 'arbiter_resolved' WHEN doc_id % 4 = 2 THEN 'partial' ELSE 'full' END AS proof, doc_id % 6 = 0 AS judge_error FROM documents""")
def v17_v24_amber_resolution(spark, sf_dir):
    """An amber claim is resolved by a provable finding with proofs; a null response marks its own claim only."""
    k = F.col("doc_id")
    proof, action = F.when(k % 4 == 3, "full").otherwise("partial"), F.when(k % 4 == 0, "supported").when(k % 4 == 1, "wrong_or_insufficient_evidence").otherwise("add_citation_or_rewrite")
    resolved = F.when((proof == "partial") & action.isin("supported", "wrong_or_insufficient_evidence"), "arbiter_resolved").otherwise(proof)
    d = read(spark, sf_dir, "documents")
    answers = d.select("doc_id", F.explode(F.array(F.lit("a"), F.when(k % 6 != 0, "b"))).alias("raw"))
    failed = answers.groupBy("doc_id").agg(F.bool_or(F.col("raw").isNull()).alias("judge_error"))
    return d.select("doc_id", resolved.alias("proof")).join(failed, "doc_id")


@query("""WITH p AS (SELECT doc_id, [doc_id % 7, doc_id % 5, 3] AS picks, [3, 4, 5] AS gold, doc_id % 3 AS g, doc_id % 4 AS o FROM documents)
  SELECT doc_id, len(list_intersect(list_distinct(picks), gold)) AS hits, CASE WHEN g = 0 AND o = 0 THEN 'X' WHEN g = 0 THEN 'A' WHEN o = 0 THEN 'B' ELSE 'C' END AS tier, g <> 0 OR o = 1 AS caught FROM p""")
def a20_a26_a27_benchmark_scores(spark, sf_dir):
    k = F.col("doc_id")
    picks, gold = F.array(k % 7, k % 5, F.lit(3).cast("long")), F.array(*[F.lit(x).cast("long") for x in (3, 4, 5)])
    added = F.array_except(F.when(k % 4 == 1, F.array(F.lit("new"))).otherwise(F.array().cast("array<string>")), F.array(F.lit("old")))
    tier = F.when((k % 3 == 0) & (k % 4 == 0), "X").when(k % 3 == 0, "A").when(k % 4 == 0, "B").otherwise("C")
    return read(spark, sf_dir, "documents").select("doc_id", F.size(F.array_intersect(F.array_distinct(picks), gold)).cast("long").alias("hits"), tier.alias("tier"), ((k % 3 != 0) | (F.size(added) > 0)).alias("caught"))


@query(r"""WITH a AS (SELECT item_id, lower(list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')[1]) AS anchor, item_id % 10 AS b FROM benchmark), d AS (SELECT doc_id, lower(text) AS body, doc_id % 10 AS b FROM documents)
  SELECT item_id, bool_or(contains(body, anchor)) AS covered, count(*) FILTER (contains(body, anchor)) AS n FROM a JOIN d USING (b) GROUP BY 1""")
def a29_coverage_anchors(spark, sf_dir):
    anchors = read(spark, sf_dir, "benchmark").select("item_id", F.lower(F.element_at(F.split(F.regexp_replace("text", r"([.!?])\s+", f"$1{t.MARK}"), t.MARK), 1)).alias("anchor"), (F.col("item_id") % 10).alias("b"))
    docs = read(spark, sf_dir, "documents").select(F.lower("text").alias("body"), (F.col("doc_id") % 10).alias("b"))
    hit = F.contains(F.col("body"), F.col("anchor"))
    return docs.join(F.broadcast(anchors), "b").groupBy("item_id").agg(F.bool_or(hit).alias("covered"), F.count_if(hit).alias("n"))
