"""Queries that assemble passes from earlier ones: pools, rescues, confirmations, overlays, renderings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import retrieve, windows
from .judging_queries import VOTES, votes
from .registry import query, read
from .retrieval_queries import COS, _cosines


@query(COS + """, q AS (SELECT *, j % 50 = 0 AS quote FROM p WHERE own = src AND (cos >= 0.2 OR j % 50 = 0)) SELECT claim, j, row_number() OVER (PARTITION BY claim ORDER BY quote DESC, CASE WHEN quote THEN 0 ELSE -cos END, j) - 1 AS ord, cos >= 0.4 AND NOT quote AND j % 9 <> 0 AS accepted FROM q""")
def r05_r06_judge_order_and_auto_accept(spark, sf_dir):
    """Sentences that hold a quoted span come first and are never accepted unread; nor are those with a cue."""
    rows = _cosines(spark, sf_dir).withColumn("quote", F.col("j") % 50 == 0).where("own = src and (cos >= 0.2 or quote)")
    order = retrieve.rank(["claim"], F.col("quote").desc(), F.when(F.col("quote"), 0.0).otherwise(-F.col("cos")), F.col("j"))
    return rows.select("claim", "j", order.cast("long").alias("ord"), ((F.col("cos") >= 0.4) & ~F.col("quote") & (F.col("j") % 9 != 0)).alias("accepted"))


@query(COS + """, u AS (SELECT claim, j, CASE WHEN j % 10 = 0 THEN -1 ELSE cos END AS cos, CASE WHEN j % 10 = 0 THEN -1 ELSE round(abs(sin(j)), 9) END AS lex FROM p WHERE own = src), r AS (SELECT *, row_number() OVER (PARTITION BY claim ORDER BY cos DESC, j) - 1 AS rc, row_number() OVER (PARTITION BY claim ORDER BY lex DESC, j) - 1 AS rl FROM u)
  SELECT claim, j FROM r QUALIFY row_number() OVER (PARTITION BY claim ORDER BY round(1.0::DOUBLE / (5 + rc) + 1.0::DOUBLE / (5 + rl), 9) DESC, j) <= 8""")
def r12_extraction_pool(spark, sf_dir):
    """The eight best of an extraction pool by fused rank; quotes that map to no sentence score -1."""
    unmapped = F.col("j") % 10 == 0
    pool = _cosines(spark, sf_dir).where("own = src").select("claim", "j", F.when(unmapped, -1.0).otherwise(F.col("cos")).alias("cos"), F.when(unmapped, -1.0).otherwise(F.round(F.abs(F.sin("j")), 9)).alias("lex"))
    fused = retrieve.fuse(pool, ["claim"], "j").withColumn("rrf", F.round("rrf", 9))
    return fused.withColumn("n", retrieve.rank(["claim"], F.col("rrf").desc(), F.col("j"))).where("n < 8").select("claim", "j")


@query(COS + """, r AS (SELECT *, row_number() OVER (PARTITION BY claim, src ORDER BY cos DESC, j) AS n FROM p), k AS (SELECT *, row_number() OVER (PARTITION BY claim, j % 97 ORDER BY src, n) AS d FROM r WHERE n <= 8)
  SELECT claim, src, j FROM k WHERE d = 1 QUALIFY row_number() OVER (PARTITION BY claim ORDER BY src, n) <= 24""")
def r14_covering_candidates(spark, sf_dir):
    """Eight of each source, equal texts once, at most 24 in the order of sources and ranks."""
    each = _cosines(spark, sf_dir).withColumn("n", retrieve.rank(["claim", "src"], F.col("cos").desc(), F.col("j"))).where("n < 8").withColumn("text_key", F.col("j") % 97)
    once = windows.first_of(each, ["claim", "text_key"], F.col("src"), F.col("n"))
    return once.withColumn("k", retrieve.rank(["claim"], F.col("src"), F.col("n"))).where("k < 24").select("claim", "src", "j")


@query(COS + """, r AS (SELECT claim, src, j, round(cos, 4) AS rel, row_number() OVER (PARTITION BY claim ORDER BY round(cos, 4) DESC, j) AS n, lead(round(cos, 4)) OVER (PARTITION BY claim ORDER BY round(cos, 4) DESC, j) AS nxt FROM p)
  SELECT claim, j, rel, n, n = 1 AND rel >= 0.3 AND rel - nxt >= 0.02 AS decided FROM r WHERE n <= 5""")
def r21_r22_relevance_and_margin(spark, sf_dir):
    """The five most relevant, and whether the best leads the second by the margin."""
    order = Window.partitionBy("claim").orderBy(F.col("rel").desc(), "j")
    rows = _cosines(spark, sf_dir).select("claim", "j", F.round("cos", 4).alias("rel"))
    rows = rows.withColumn("n", F.row_number().over(order).cast("long")).withColumn("nxt", F.lead("rel").over(order)).where("n <= 5")
    return rows.select("claim", "j", "rel", "n", ((F.col("n") == 1) & (F.col("rel") >= 0.3) & (F.col("rel") - F.col("nxt") >= 0.02)).alias("decided"))


@query(COS + " SELECT claim, arg_max(c, (best, -c)) AS chunk FROM (SELECT claim, j // 25 AS c, max(cos) AS best FROM p GROUP BY 1, 2) GROUP BY claim")
def r23_top_chunk(spark, sf_dir):
    chunks = _cosines(spark, sf_dir).groupBy("claim", F.floor(F.col("j") / 25).alias("c")).agg(F.max("cos").alias("best"))
    return chunks.groupBy("claim").agg(F.max_by("c", F.struct("best", -F.col("c"))).alias("chunk"))


@query("SELECT 'src' || (doc_id % 30) AS marker, min(doc_id) AS claim, arg_min(lang, doc_id) AS gold FROM documents GROUP BY 1")
def j17_j18_marker_gold_join(spark, sf_dir):
    """A gold label belongs to the first claim that carries its marker."""
    d = read(spark, sf_dir, "documents").withColumn("marker", F.concat(F.lit("src"), F.col("doc_id") % 30))
    first = windows.first_of(d, ["marker"], F.col("doc_id"))
    return first.select("marker", F.col("doc_id").alias("claim"), F.col("lang").alias("gold"))


@query("""WITH r AS (SELECT DISTINCT o_custkey AS citing, o_orderkey % 150 AS cited FROM orders), p AS (SELECT a.c_custkey AS a, b.c_custkey AS b FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_custkey < b.c_custkey)
  SELECT a, b, x.citing IS NOT NULL AS a_cites_b, y.citing IS NOT NULL AS b_cites_a FROM p LEFT JOIN r x ON x.citing = a AND x.cited = b LEFT JOIN r y ON y.citing = b AND y.cited = a WHERE x.citing IS NOT NULL OR y.citing IS NOT NULL""")
def d14_j20_direct_citation(spark, sf_dir):
    r = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("citing"), (F.col("o_orderkey") % 150).alias("cited")).distinct()
    c = read(spark, sf_dir, "customer").select("c_nationkey", F.col("c_custkey").alias("k"))
    ab = r.select(F.least("citing", "cited").alias("a"), F.greatest("citing", "cited").alias("b"), (F.col("citing") < F.col("cited")).alias("forward")).where("a < b")
    ab = ab.groupBy("a", "b").agg(F.bool_or("forward").alias("a_cites_b"), F.bool_or(~F.col("forward")).alias("b_cites_a"))
    na, nb = c.select(F.col("k").alias("a"), F.col("c_nationkey").alias("n")), c.select(F.col("k").alias("b"), F.col("c_nationkey").alias("n"))
    return ab.join(na, "a").join(nb, ["b", "n"]).select("a", "b", "a_cites_b", "b_cites_a")


@query("SELECT s_suppkey, CASE WHEN n_nationkey % 3 = 0 THEN s_name ELSE s_name || ' — ' || n_name END AS title, CASE WHEN s_suppkey % 4 = 0 THEN 'k' || s_suppkey || '.pdf' ELSE 'own' || s_suppkey || '.pdf' END AS filename FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def j21_c22_manifest_enrichment(spark, sf_dir):
    """Titles with their author where the manifest has one; an existing file name wins over the minted one."""
    s = read(spark, sf_dir, "supplier").join(F.broadcast(read(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    existing = s.where("s_suppkey % 4 <> 0").select(F.col("s_suppkey").alias("k"), F.concat(F.lit("own"), "s_suppkey", F.lit(".pdf")).alias("f"))
    author = F.when(F.col("n_nationkey") % 3 != 0, F.col("n_name"))
    return s.join(existing, F.col("s_suppkey") == F.col("k"), "left").select("s_suppkey", F.concat_ws(" — ", "s_name", author).alias("title"), F.coalesce("f", F.concat(F.lit("k"), "s_suppkey", F.lit(".pdf"))).alias("filename"))


@query("SELECT n_nationkey, 'model-' || n_nationkey AS model, n_nationkey / 100.0 AS price_in, n_nationkey / 10.0 AS price_out FROM nation")
def a15_price_table(spark, sf_dir):
    """Rows of a Markdown price table read back."""
    k = F.col("n_nationkey")
    line = F.concat(F.lit("| `model-"), k, F.lit("` | $"), F.format_string("%.2f", k / 100.0), F.lit(" / $"), F.format_string("%.1f", k / 10.0), F.lit(" |"))
    pattern = r"\|\s*`([^`]+)`\s*\|\s*\$([0-9.]+)\s*/\s*\$([0-9.]+)"
    return read(spark, sf_dir, "nation").select("n_nationkey", F.regexp_extract(line, pattern, 1).alias("model"), F.regexp_extract(line, pattern, 2).cast("double").alias("price_in"), F.regexp_extract(line, pattern, 3).cast("double").alias("price_out"))


@query(COS + " SELECT claim, max(cos) >= 0.3 AS faithful, count(*) FILTER (cos >= 0.35) AS near, round(count(*) FILTER (cos >= 0.35) / count(*), 6) AS rate FROM p GROUP BY claim")
def a23_faithful_and_duplicate_rates(spark, sf_dir):
    near = F.count_if(F.col("cos") >= 0.35)
    return _cosines(spark, sf_dir).groupBy("claim").agg((F.max("cos") >= 0.3).alias("faithful"), near.alias("near"), F.round(near / F.count("*"), 6).alias("rate"))


@query("""WITH g AS (SELECT doc_id % 200 AS claim, quality, toxic, doc_id FROM labels), l AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY claim ORDER BY doc_id DESC) = 1)
  SELECT quality = toxic AS agree, CASE WHEN quality > toxic THEN 'up' WHEN quality < toxic THEN 'down' ELSE 'same' END AS direction, count(*) AS n FROM l GROUP BY 1, 2""")
def a25_grader_agreement(spark, sf_dir):
    """Of a claim's grades the last counts."""
    g = read(spark, sf_dir, "labels").withColumn("claim", F.col("doc_id") % 200)
    q, x = F.col("quality"), F.col("toxic")
    last = windows.first_of(g, ["claim"], F.col("doc_id").desc())
    return last.groupBy((q == x).alias("agree"), F.when(q > x, "up").when(q < x, "down").otherwise("same").alias("direction")).agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN n_chars = 0 THEN 'missing' WHEN n_chars < 900 THEN 'thin' WHEN lang <> 'en' THEN 'mismatch' ELSE 'present' END AS status, count(*) AS n, sum(n_chars) AS chars FROM documents GROUP BY 1")
def a31_download_status(spark, sf_dir):
    n = F.col("n_chars")
    status = F.when(n == 0, "missing").when(n < 900, "thin").when(F.col("lang") != "en", "mismatch").otherwise("present")
    return read(spark, sf_dir, "documents").groupBy(status.alias("status")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'y' WHEN 1 THEN 'n' WHEN 2 THEN '' ELSE 'old' END AS human, CASE WHEN event_id % 3 = 0 THEN 'n' ELSE 'old' END AS llm FROM events")
def n07_review_merge(spark, sf_dir):
    """Lines such as ``7 | H:[y] | L:[ ]`` merged into stored reviews; an empty mark leaves what was there."""
    k = F.col("event_id")
    e = read(spark, sf_dir, "events")
    mark = F.when(k % 4 == 0, "y").when(k % 4 == 1, "n").otherwise(" ")
    line = F.concat(k, F.lit(" | H:["), mark, F.lit("] | L:["), F.when(k % 3 == 0, "n").otherwise(" "), F.lit("]"))
    stored = e.select(k.alias("id"), F.when(k % 4 == 2, "").otherwise("old").alias("h"), F.lit("old").alias("l"))
    got = e.select(F.regexp_extract(line, r"^(\d+)", 1).cast("long").alias("id"), F.nullif(F.regexp_extract(line, r"H:\[([yn]?)", 1), F.lit("")).alias("nh"), F.nullif(F.regexp_extract(line, r"L:\[([yn]?)", 1), F.lit("")).alias("nl"))
    return stored.join(got, "id", "left").select(F.col("id").alias("event_id"), F.coalesce("nh", "h").alias("human"), F.coalesce("nl", "l").alias("llm"))


@query(COS + """, w AS (SELECT claim, j, cos, j % 7 AS answer, j // 40 % 5 = 3 AS lost FROM p WHERE own <> src AND cos >= 0.3) SELECT claim, j, CASE WHEN lost OR answer IN (5, 6) THEN CASE WHEN cos >= 0.42 THEN 'strong' ELSE 'weak' END ELSE 'strong' END AS strength FROM w WHERE lost OR answer <> 0""")
def d02_d10_d21_batched_confirm(spark, sf_dir):
    """An explicit negative removes a pair, an explicit positive makes it strong; no answer, or a lost batch, changes nothing."""
    w = _cosines(spark, sf_dir).where("own <> src and cos >= 0.3")
    lost, answer = F.floor(F.col("j") / 40) % 5 == 3, F.col("j") % 7
    relation = F.when(lost | answer.isin(5, 6), None).when(answer == 0, "different_claim").otherwise("restatement")
    graded = w.select("claim", "j", "cos", relation.alias("relation")).where(F.coalesce("relation", F.lit("")) != "different_claim")
    return graded.select("claim", "j", F.when(F.col("relation").isNotNull() | (F.col("cos") >= 0.42), "strong").otherwise("weak").alias("strength"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'id' WHEN p_partkey % 3 = 0 THEN 'doi' WHEN p_partkey % 2 = 0 THEN 'title' ELSE 'stop' END AS how, CASE WHEN p_partkey % 4 > p_partkey % 6 THEN 'numeric' ELSE 'author-year' END AS style FROM part""")
def d25_d26_identification_ladder(spark, sf_dir):
    """The first rung that resolves decides; the recogniser with more resolved groups wins, a tie goes to author-year."""
    k = F.col("p_partkey")
    rungs = F.array(F.struct(F.lit(1).alias("rung"), F.lit("id").alias("how"), (k % 5 == 0).alias("ok")), F.struct(F.lit(2).alias("rung"), F.lit("doi").alias("how"), (k % 3 == 0).alias("ok")), F.struct(F.lit(3).alias("rung"), F.lit("title").alias("how"), (k % 2 == 0).alias("ok")))
    p = read(spark, sf_dir, "part")
    tries = p.select("p_partkey", F.explode(rungs).alias("r")).where("r.ok").groupBy("p_partkey").agg(F.min_by("r.how", "r.rung").alias("how"))
    return p.join(tries, "p_partkey", "left").select("p_partkey", F.coalesce("how", F.lit("stop")).alias("how"), F.when(k % 4 > k % 6, "numeric").otherwise("author-year").alias("style"))


@query(r"""SELECT conv_id, string_agg('[' || role || '] ' || text, chr(10) || chr(10) ORDER BY turn) AS passage, arg_min(turn, turn) FILTER (turn % 2 = 1) AS rescued FROM conversations GROUP BY 1 HAVING count(*) FILTER (turn % 2 = 1) > 0""")
def v02_v06_combined_passage_and_rescue(spark, sf_dir):
    """Labelled windows joined by blank lines; the shortest suffix that was supported rescues."""
    c = read(spark, sf_dir, "conversations")
    parts = F.array_sort(F.collect_list(F.struct("turn", F.concat(F.lit("["), "role", F.lit("] "), "text").alias("w"))))
    rows = c.groupBy("conv_id").agg(parts.alias("p"), F.min(F.when(F.col("turn") % 2 == 1, F.col("turn"))).alias("rescued")).where("rescued is not null")
    return rows.select("conv_id", F.array_join("p.w", "\n\n").alias("passage"), "rescued")


@query("""WITH a AS (SELECT DISTINCT l_orderkey AS claim, l_suppkey AS src FROM lineitem), n AS (SELECT claim, count(*) AS n FROM a GROUP BY 1 HAVING count(*) BETWEEN 2 AND 3)
  SELECT a.claim, a.src AS without, string_agg(CAST(b.src AS VARCHAR), ',' ORDER BY b.src) AS rest FROM a JOIN n USING (claim) JOIN a b ON b.claim = a.claim AND b.src <> a.src GROUP BY 1, 2""")
def v09_leave_one_out(spark, sf_dir):
    """For claims with two or three sources, the union of the others for each source left out."""
    a = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("claim"), F.col("l_suppkey").alias("src")).distinct()
    few = a.groupBy("claim").agg(F.array_sort(F.collect_list("src")).alias("all"), F.count("*").alias("n")).where("n between 2 and 3")
    rows = few.select("claim", F.explode("all").alias("without"), "all")
    return rows.select("claim", "without", F.array_join(F.array_remove("all", F.col("without")), ",").alias("rest"))


@query(f"WITH v AS ({VOTES}), f AS (SELECT claim, max(vote_no) AS last FROM v WHERE supported GROUP BY 1) SELECT v.claim, v.vote_no, v.reason, CASE WHEN v.vote_no = 2 THEN '' ELSE coalesce(CAST(f.last AS VARCHAR), '') END AS flag FROM v LEFT JOIN f USING (claim)")
def v14_v15_i06_overlays(spark, sf_dir):
    """Later feedback wins and is laid over the rows; a pass that is switched off (vote 2) leaves an empty flag."""
    v = votes(spark, sf_dir)
    last = v.where("supported").groupBy("claim").agg(F.max("vote_no").alias("last"))
    return v.join(last, "claim", "left").select("claim", "vote_no", "reason", F.when(F.col("vote_no") == 2, "").otherwise(F.coalesce(F.col("last").cast("string"), F.lit(""))).alias("flag"))


@query("SELECT doc_id, doc_id % 3 = 0 AS date_inferred FROM documents")
def v19_date_inferred(spark, sf_dir):
    """A year of the claim that no shown sentence has, but that is the document's own year."""
    k = F.col("doc_id")
    years = t.extract_all(F.concat(F.lit("in 2019 and "), F.when(k % 3 == 0, "2021").otherwise("2020")), r"(?:19|20)\d{2}")
    shown = t.extract_all(F.lit("seen 2019 and 2020"), r"(?:19|20)\d{2}")
    missing = F.array_except(years, shown)
    return read(spark, sf_dir, "documents").select("doc_id", ((F.size(missing) > 0) & F.forall(missing, lambda y: y == "2021")).alias("date_inferred"))


@query("""SELECT n_regionkey AS map, string_agg('[' || n_name || ']' || CASE WHEN n_nationkey % 2 = 0 THEN chr(10) || '  + <' || n_nationkey || '>' ELSE '' END, chr(10) ORDER BY n_nationkey) AS argdown FROM nation GROUP BY 1""")
def c21_argument_text(spark, sf_dir):
    """A map rendered as indented text, in document order."""
    line = F.concat(F.lit("["), "n_name", F.lit("]"), F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("\n  + <"), "n_nationkey", F.lit(">"))).otherwise(""))
    parts = read(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("map")).agg(F.array_sort(F.collect_list(F.struct("n_nationkey", line.alias("l")))).alias("p"))
    return parts.select("map", F.array_join("p.l", "\n").alias("argdown"))
