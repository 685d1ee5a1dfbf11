"""Queries of votes, verdicts, roll-ups, joins between runs and JSON answers (A, V, J, S, N, I, C)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import judge, windows
from .registry import query, read

#: Judged claims made from events, in SQL that both engines read.
CLAIMS = """SELECT event_id AS claim, user_id, CASE WHEN event_id % 5 < 2 THEN 'supported' WHEN event_id % 5 < 4 THEN 'unsupported' ELSE 'own' END AS verdict,
  CASE WHEN event_id % 17 = 3 THEN 'source_file_missing: a.pdf' ELSE 'judged' END AS reason,
  CASE event_id % 7 WHEN 0 THEN 'llm_fulltext' WHEN 1 THEN 'combined_fulltext' WHEN 2 THEN 'tail_rescue' ELSE 'llm' END AS method,
  CASE event_id % 4 WHEN 0 THEN '2-1' ELSE '2-0' END AS votes, (event_id % 100) / 100.0 AS cosine, event_id % 11 = 0 AS partial,
  CASE event_id % 6 WHEN 0 THEN 'partial' WHEN 1 THEN 'full' END AS proof, CASE event_id % 13 WHEN 0 THEN FALSE WHEN 1 THEN TRUE END AS agrees,
  event_id % 3 <> 0 AS has_sentence, event_id % 19 = 0 AS ruled, CASE event_id % 8 WHEN 0 THEN 'methods' WHEN 1 THEN 'related' WHEN 2 THEN 'full' END AS scope,
  event_id % 9 = 0 AS uncovered, event_id % 10 = 0 AS conflict, event_id % 3 AS n_markers,
  CASE event_id % 6 WHEN 0 THEN 'supported' WHEN 1 THEN 'wrong_or_insufficient_evidence' WHEN 2 THEN 'add_citation_or_rewrite' END AS action, event_id % 2 = 0 AS proofs FROM {events}"""
CTE = f"WITH c AS ({CLAIMS.format(events='events')})"


def claims(spark, sf_dir):
    return spark.sql(CLAIMS.format(events="{events}"), events=read(spark, sf_dir, "events"))


@query(CTE + """ SELECT claim, CASE WHEN verdict = 'own' OR (verdict = 'unsupported' AND reason LIKE 'source_file_missing%') THEN NULL
  WHEN agrees = FALSE OR partial OR (verdict = 'supported' AND proof = 'partial') OR votes = '2-1' THEN 'low'
  WHEN method IN ('combined_fulltext', 'tail_rescue') OR (verdict = 'unsupported' AND NOT has_sentence) OR (verdict = 'supported' AND method = 'llm_fulltext' AND cosine < 0.75) THEN 'medium' ELSE 'high' END AS label FROM c""")
def a10_confidence_label(spark, sf_dir):
    c = F.col
    label = judge.confidence(c("verdict"), c("reason"), c("agrees"), c("partial"), c("proof"), c("votes") == "2-1", c("method"), c("cosine"), c("has_sentence"))
    return claims(spark, sf_dir).select("claim", label.alias("label"))


@query(CTE + """ SELECT claim, CASE WHEN verdict = 'own' THEN 'own' WHEN verdict = 'unsupported' AND scope IN ('methods', 'related') THEN 'scopedcite' WHEN verdict = 'unsupported' THEN 'unsupported' WHEN proof = 'partial' THEN 'amber' ELSE 'supported' END AS shown,
  CASE WHEN verdict = 'own' OR reason LIKE 'source_file_missing%' OR ruled THEN NULL WHEN verdict = 'unsupported' THEN 'unsupported' WHEN partial THEN 'partial_support' WHEN uncovered THEN 'uncovered_components' WHEN conflict THEN 'conflict_candidate' END AS why,
  verdict = 'unsupported' AND n_markers > 0 AND reason NOT LIKE 'source_file_missing%' AND NOT ruled AS scope_eligible, verdict <> 'own' AND reason NOT LIKE 'source_file_missing%' AND NOT ruled AND has_sentence AS checkable FROM c""")
def a12_p16_p17_p23_display_and_triggers(spark, sf_dir):
    c = F.col
    return claims(spark, sf_dir).select(
        "claim", judge.display_class(c("verdict"), c("scope"), c("proof")).alias("shown"),
        judge.arbiter_trigger(c("verdict"), c("reason"), c("ruled"), c("partial"), c("uncovered"), c("conflict")).alias("why"),
        judge.eligible_for_scope(c("verdict"), c("n_markers"), c("reason"), c("ruled")).alias("scope_eligible"),
        judge.checkable(c("verdict"), c("reason"), c("ruled"), c("has_sentence")).alias("checkable"),
    )


@query(CTE + """, b AS (SELECT claim, verdict, action, proofs, CASE WHEN verdict <> 'supported' THEN 'not_supported' WHEN partial OR uncovered THEN 'partially_supported' ELSE 'supported' END AS strict FROM c)
  SELECT claim, strict, CASE WHEN action = 'supported' OR (action = 'wrong_or_insufficient_evidence' AND proofs) THEN 'supported' WHEN action = 'add_citation_or_rewrite' AND (verdict <> 'unsupported' OR proofs) THEN 'partially_supported' ELSE strict END AS adjudicated FROM b""")
def a17_a18_scoring_buckets(spark, sf_dir):
    c = F.col
    partial = c("partial") | c("uncovered")
    return claims(spark, sf_dir).select("claim", judge.bucket(c("verdict"), partial).alias("strict"), judge.adjudicated(c("verdict"), partial, c("action"), c("proofs")).alias("adjudicated"))


@query(CTE + " SELECT count(*) AS claims, count(*) FILTER (verdict = 'supported') AS supported, count(*) FILTER (verdict = 'unsupported') AS unsupported, count(*) FILTER (verdict = 'own') AS own, count(*) FILTER (scope = 'methods') AS methods, count(*) FILTER (scope = 'concept') AS concept, count(*) FILTER (scope = 'related') AS related FROM c")
def a05_a09_coverage_totals(spark, sf_dir):
    when = lambda column, value: F.count_if(F.col(column) == value).alias(value)
    return claims(spark, sf_dir).agg(F.count("*").alias("claims"), *[when("verdict", v) for v in ("supported", "unsupported", "own")], *[when("scope", v) for v in ("methods", "concept", "related")])


@query("""WITH c AS (SELECT l_orderkey AS claim, l_suppkey AS source, min(l_linenumber) AS line, bool_or(l_returnflag = 'A') AS won FROM lineitem GROUP BY 1, 2), v AS (SELECT claim, bool_or(won) AS supported FROM c GROUP BY 1)
  SELECT source, count(*) AS cited_by, count(*) FILTER (v.supported) AS citing_supported, count(*) FILTER (c.won) AS supported, CASE WHEN count(*) FILTER (c.won) > 0 THEN 'backs' WHEN count(*) FILTER (v.supported) > 0 THEN 'co-cited' ELSE 'none' END AS status FROM c JOIN v USING (claim) GROUP BY source""")
def a06_a11_coverage_per_source(spark, sf_dir):
    c = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("claim"), F.col("l_suppkey").alias("source")).agg(F.bool_or(F.col("l_returnflag") == "A").alias("won"))
    v = c.groupBy("claim").agg(F.bool_or("won").alias("verdict"))
    rows = c.join(v, "claim").groupBy("source").agg(F.count("*").alias("cited_by"), F.count_if("verdict").alias("citing_supported"), F.count_if("won").alias("supported"))
    return rows.withColumn("status", F.when(F.col("supported") > 0, "backs").when(F.col("citing_supported") > 0, "co-cited").otherwise("none"))


VOTES = """SELECT event_id // 3 AS claim, event_id % 3 + 1 AS vote_no, CAST(floor(coalesce(value, 0) * 100) AS BIGINT) % 2 = 0 AS supported, event_type AS reason FROM events"""


def votes(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return e.select(F.floor(F.col("event_id") / 3).alias("claim"), (F.col("event_id") % 3 + 1).alias("vote_no"), (F.floor(F.coalesce("value", F.lit(0.0)) * 100) % 2 == 0).alias("supported"), F.col("event_type").alias("reason"))


@query(f"""WITH v AS ({VOTES}), p AS (SELECT claim, max(supported) FILTER (vote_no = 1) AS a, max(supported) FILTER (vote_no = 2) AS b, count(*) FILTER (vote_no <= 2) AS two FROM v GROUP BY claim),
  u AS (SELECT v.* FROM v JOIN p USING (claim) WHERE vote_no <= 2 OR two < 2 OR a <> b), s AS (SELECT claim, count(*) AS n, count(*) FILTER (supported) AS t, arg_min(reason, vote_no) FILTER (supported) AS yes, arg_min(reason, vote_no) FILTER (NOT supported) AS no FROM u JOIN p USING (claim) WHERE two > 0 GROUP BY claim)
  SELECT claim, t * 2 > n AS supported, greatest(t, n - t) || '-' || least(t, n - t) AS tally, CASE WHEN t * 2 > n THEN yes ELSE no END AS reason FROM s""")
def a01_a02_vote_tally(spark, sf_dir):
    return judge.majority(votes(spark, sf_dir), "claim")


@query(f"WITH v AS ({VOTES}), s AS (SELECT claim, count(*) AS n, count(*) FILTER (supported) AS t, max(supported) FILTER (vote_no = 1) AS first FROM v GROUP BY claim) SELECT claim, CASE WHEN first THEN TRUE ELSE t * 2 > n END AS agrees, t >= 2 AS kept FROM s WHERE n = 3")
def a03_a04_second_opinion_confirm(spark, sf_dir):
    """A disagreement at the first vote stands only if the majority of three disagrees; a pick stays with two of three."""
    s = votes(spark, sf_dir).groupBy("claim").agg(F.count("*").alias("n"), F.count_if("supported").alias("t"), F.max(F.when(F.col("vote_no") == 1, F.col("supported"))).alias("first"))
    return s.where("n = 3").select("claim", F.when(F.col("first"), True).otherwise(F.col("t") * 2 > F.col("n")).alias("agrees"), (F.col("t") >= 2).alias("kept"))


@query(f"WITH v AS ({VOTES}) SELECT claim, arg_min(vote_no, vote_no + CASE WHEN supported THEN 0 ELSE 10 END) AS ord, bool_or(supported) AS supported, arg_min(reason, vote_no + CASE WHEN supported THEN 0 ELSE 10 END) AS reason FROM v GROUP BY claim")
def v01_first_supported(spark, sf_dir):
    return judge.first_supported(votes(spark, sf_dir).withColumnRenamed("vote_no", "ord"), ["claim"])


@query(CTE + " SELECT user_id, min(claim) FILTER (verdict = 'supported') AS lead, count(*) FILTER (reason LIKE 'source_file_missing%') AS missing, CASE WHEN count(*) FILTER (n_markers > 0) = 0 THEN 'own' WHEN bool_or(verdict = 'supported') THEN 'supported' ELSE 'unsupported' END AS verdict FROM c GROUP BY user_id")
def v07_claim_verdict(spark, sf_dir):
    c = F.col
    rows = claims(spark, sf_dir).groupBy("user_id").agg(
        F.min(F.when(c("verdict") == "supported", c("claim"))).alias("lead"), F.count_if(c("reason").startswith(judge.MISSING)).alias("missing"), F.count_if(c("n_markers") > 0).alias("m"), F.bool_or(c("verdict") == "supported").alias("s"), F.count("*").alias("n")
    )
    return rows.select("user_id", "lead", "missing", judge.verdict(F.lit(None).cast("string"), F.lit(False), c("m"), c("n"), c("s")).alias("verdict"))


@query("""WITH g AS (SELECT doc_id, [source, lang] AS uncovered, CASE WHEN doc_id % 3 = 0 THEN [source, lang] WHEN doc_id % 3 = 1 THEN [lang] ELSE [] END AS common, doc_id % 4 <> 0 AS has FROM documents)
  SELECT doc_id, CASE WHEN has THEN CASE WHEN len(list_filter(uncovered, lambda x: NOT list_contains(common, x))) > 0 THEN 'partial' ELSE 'full' END END AS proof FROM g""")
def a13_proof_state(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    common = F.when(F.col("doc_id") % 3 == 0, F.array("source", "lang")).when(F.col("doc_id") % 3 == 1, F.array("lang")).otherwise(F.array().cast("array<string>"))
    return d.select("doc_id", judge.proof_state(F.col("doc_id") % 4 != 0, F.array("source", "lang"), common).alias("proof"))


@query("SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL")
def a16_confusion(spark, sf_dir):
    return read(spark, sf_dir, "labels").groupBy("quality", "toxic").agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT count(*) AS n, count(*) FILTER (quality = toxic) AS same, count(*) FILTER (quality = 1) AS q, count(*) FILTER (toxic = 1) AS t, count(*) FILTER (quality = 0 AND toxic = 1) AS fs FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL),
  k AS (SELECT *, same / n AS po, (q / n) * (t / n) + (1 - q / n) * (1 - t / n) AS pe FROM s) SELECT n, same, floor(100 * same / n) AS percent, fs AS false_support, CASE WHEN pe = 1 THEN 1.0 ELSE round((po - pe) / (1 - pe), 6) END AS kappa FROM k""")
def a19_a21_kappa_and_false_support(spark, sf_dir):
    q, x = F.col("quality"), F.col("toxic")
    s = read(spark, sf_dir, "labels").where(q.isNotNull() & x.isNotNull()).agg(F.count("*").alias("n"), F.count_if(q == x).alias("same"), F.count_if(q == 1).alias("q"), F.count_if(x == 1).alias("t"), F.count_if((q == 0) & (x == 1)).alias("false_support"))
    pq, pt = F.col("q") / F.col("n"), F.col("t") / F.col("n")
    s = s.withColumn("po", F.col("same") / F.col("n")).withColumn("pe", pq * pt + (1 - pq) * (1 - pt))
    return s.select("n", "same", F.floor(100 * F.col("same") / F.col("n")).cast("double").alias("percent"), "false_support", F.when(F.col("pe") == 1, 1.0).otherwise(F.round((F.col("po") - F.col("pe")) / (1 - F.col("pe")), 6)).alias("kappa"))


@query("""SELECT d.source, count(*) AS docs, round(1000.0 * count(*) / sum(n_chars / 6.0), 6) AS per_1k_words, count(l.doc_id) AS graded, count(*) FILTER (l.quality = 0) AS bad, round(avg(CASE WHEN l.quality = 0 THEN 1.0 WHEN l.quality = 1 THEN 0.0 END), 6) AS bad_rate FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.source""")
def a22_a24_quality_rollup(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    q = F.col("quality")
    return d.groupBy("source").agg(F.count("*").alias("docs"), F.round(1000.0 * F.count("*") / F.sum(F.col("n_chars") / 6.0), 6).alias("per_1k_words"), F.count(F.coalesce("quality", "toxic")).alias("graded"), F.count_if(q == 0).alias("bad"), F.round(F.avg(F.when(q == 0, 1.0).when(q == 1, 0.0)), 6).alias("bad_rate"))


PRICES = {"view": (0.10, 0.40), "click": (0.30, 2.50), "purchase": (0.09, 0.18)}


@query("""WITH p(event_type, price_in, price_out) AS (VALUES ('view', 0.10, 0.40), ('click', 0.30, 2.50), ('purchase', 0.09, 0.18))
  SELECT e.event_type, count(*) AS calls, CAST(sum(e.user_id) AS BIGINT) AS tokens, round(CAST(sum(e.user_id) AS DOUBLE) * max(p.price_in) / 1000000, 9) AS cost FROM events e LEFT JOIN p USING (event_type) GROUP BY 1""")
def a14_c23_usage_ledger(spark, sf_dir):
    """Calls, tokens and cost by model, where the event type stands for the model; an unknown model has no cost."""
    prices = spark.createDataFrame([(k, *v) for k, v in PRICES.items()], "event_type string, price_in double, price_out double")
    e = read(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("calls"), F.sum("user_id").alias("tokens"))
    return e.join(F.broadcast(prices), "event_type", "left").select("event_type", "calls", "tokens", F.round(F.col("tokens") * F.col("price_in") / 1000000, 9).alias("cost"))


@query("SELECT user_id, approx AS kinds FROM (SELECT user_id, count(DISTINCT event_type) AS approx FROM events GROUP BY 1)")
def a32_a33_distinct_counts(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("user_id").agg(F.count_distinct("event_type").alias("kinds"))


# Joins between claims, files and runs


@query("""WITH refs AS (SELECT 'src' || (n_nationkey % 7) AS key, n_name || '.pdf' AS filename, n_nationkey AS line FROM nation), m AS (SELECT key, arg_max(filename, line) AS filename FROM refs GROUP BY key), c AS (SELECT doc_id, 'src' || (doc_id % 9) AS key FROM documents)
  SELECT doc_id, c.key, filename, sha1(filename) AS paper_id, filename IS NULL AS unmapped FROM c LEFT JOIN m USING (key)""")
def j01_c03_marker_to_file(spark, sf_dir):
    """The last line of a key wins; an unmapped key stays with a null file."""
    n = read(spark, sf_dir, "nation").select(F.concat(F.lit("src"), F.col("n_nationkey") % 7).alias("key"), F.concat("n_name", F.lit(".pdf")).alias("filename"), F.col("n_nationkey").alias("line"))
    refs = n.groupBy("key").agg(F.max_by("filename", "line").alias("filename"))
    c = read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("src"), F.col("doc_id") % 9).alias("key"))
    return c.join(F.broadcast(refs), "key", "left").select("doc_id", "key", "filename", F.sha1("filename").alias("paper_id"), F.col("filename").isNull().alias("unmapped"))


RUNS = "now AS (SELECT doc_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS k, source FROM documents WHERE doc_id % 10 <> 3), was AS (SELECT doc_id AS old_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS k, source FROM documents WHERE doc_id % 10 <> 4), a AS (SELECT *, row_number() OVER (PARTITION BY k, source ORDER BY doc_id) AS n FROM now), b AS (SELECT *, row_number() OVER (PARTITION BY k, source ORDER BY old_id) AS n FROM was)"


def match_runs(now, was):
    """Exact match of a run's claims with the previous one by text and markers; repeated texts pair up in order."""
    a = now.withColumn("n", F.row_number().over(Window.partitionBy("k", "source").orderBy("doc_id")))
    b = was.withColumn("n", F.row_number().over(Window.partitionBy("k", "source").orderBy("old_id")))
    return a.join(b, ["k", "source", "n"], "left")


def _runs(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    key = F.sha2(F.lower(F.trim(F.regexp_replace("text", r"\s+", " "))), 256)
    return d.where("doc_id % 10 <> 3").select("doc_id", key.alias("k"), "source"), d.where("doc_id % 10 <> 4").select(F.col("doc_id").alias("old_id"), key.alias("k"), "source")


@query(f"WITH {RUNS} SELECT a.doc_id, coalesce(b.old_id, -1) AS old_id FROM a LEFT JOIN b ON a.k = b.k AND a.source = b.source AND a.n = b.n")
def j08_previous_run_match(spark, sf_dir):
    return match_runs(*_runs(spark, sf_dir)).select("doc_id", F.coalesce("old_id", F.lit(-1)).alias("old_id"))


@query(f"WITH {RUNS}, m AS (SELECT a.doc_id, b.old_id FROM a LEFT JOIN b ON a.k = b.k AND a.source = b.source AND a.n = b.n) SELECT doc_id, old_id IS NOT NULL AND doc_id % 7 <> 0 AND doc_id % 5 <> 0 AS reused, CASE WHEN old_id IS NULL THEN 'new' WHEN old_id <> doc_id THEN 'moved' ELSE 'same' END AS change FROM m")
def i02_i03_i04_p15_reuse_decision(spark, sf_dir):
    """Reused only if matched, reusable (no failed call: every seventh) and no cited file changed (every fifth)."""
    m = match_runs(*_runs(spark, sf_dir))
    reused = F.col("old_id").isNotNull() & (F.col("doc_id") % 7 != 0) & (F.col("doc_id") % 5 != 0)
    return m.select("doc_id", reused.alias("reused"), F.when(F.col("old_id").isNull(), "new").when(F.col("old_id") != F.col("doc_id"), "moved").otherwise("same").alias("change"))


@query("""WITH now AS (SELECT source, md5(string_agg(md5(text), '' ORDER BY doc_id)) AS h FROM documents GROUP BY 1), was AS (SELECT source, md5(string_agg(md5(text), '' ORDER BY doc_id)) AS h FROM documents WHERE source <> 'src3' AND NOT (source = 'src5' AND doc_id % 2 = 0) GROUP BY 1)
  SELECT coalesce(n.source, w.source) AS source, CASE WHEN w.h IS NULL THEN 'new' WHEN n.h IS NULL THEN 'gone' WHEN n.h <> w.h THEN 'changed' ELSE 'same' END AS status FROM now n FULL JOIN was w ON n.source = w.source""")
def i01_s05_changed_sources(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "source", F.md5("text").alias("m"))

    def hashes(rows):
        parts = F.array_sort(F.collect_list(F.struct("doc_id", "m")))
        return rows.groupBy("source").agg(F.md5(F.array_join(parts["m"], "")).alias("h"))

    now, was = hashes(d), hashes(d.where("source <> 'src3' and not (source = 'src5' and doc_id % 2 = 0)")).withColumnRenamed("h", "old")
    status = F.when(F.col("old").isNull(), "new").when(F.col("h").isNull(), "gone").when(F.col("h") != F.col("old"), "changed").otherwise("same")
    return now.join(was, "source", "full").select("source", status.alias("status"))


@query("""WITH a AS (SELECT o_orderkey AS k, o_orderstatus AS v FROM orders WHERE o_orderkey % 3 <> 0), b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS v FROM orders WHERE o_orderkey % 4 <> 0)
  SELECT coalesce(a.k, b.k) AS claim, CASE WHEN a.k IS NULL THEN 'removed' WHEN b.k IS NULL THEN 'added' WHEN a.v <> b.v THEN 'flipped' ELSE 'same' END AS status FROM a FULL JOIN b ON a.k = b.k""")
def j19_d11_run_diff(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    a = o.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("claim"), F.col("o_orderstatus").alias("v"))
    b = o.where("o_orderkey % 4 <> 0").select(F.col("o_orderkey").alias("claim"), F.when(F.col("o_orderkey") % 5 == 0, "X").otherwise(F.col("o_orderstatus")).alias("w"))
    return a.join(b, "claim", "full").select("claim", F.when(F.col("v").isNull(), "removed").when(F.col("w").isNull(), "added").when(F.col("v") != F.col("w"), "flipped").otherwise("same").alias("status"))


@query("""WITH a AS (SELECT p_partkey AS i, p_partkey % 50 AS k FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 5 = 0), b AS (SELECT p_partkey AS i, (p_partkey + CASE WHEN p_partkey % 20 = 0 THEN 1 ELSE 0 END) % 50 AS k FROM part WHERE p_partkey % 3 = 0 OR p_partkey % 5 = 0),
  f AS (SELECT coalesce(a.i, b.i) AS i, a.k AS ka, b.k AS kb FROM a FULL JOIN b ON a.i = b.i), n AS (SELECT count(*) FILTER (ka = kb) AS agree FROM f)
  SELECT i, coalesce(CASE WHEN ka = kb THEN ka WHEN ka IS NOT NULL AND kb IS NOT NULL THEN NULL WHEN agree >= 3 THEN coalesce(ka, kb) END, -1) AS k FROM f, n""")
def j13_two_witness_alignment(spark, sf_dir):
    """Two witnesses that agree decide; one alone counts only if at least three agreements support the run."""
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("i"))
    a = p.where("i % 2 = 0 or i % 5 = 0").select("i", (F.col("i") % 50).alias("ka"))
    b = p.where("i % 3 = 0 or i % 5 = 0").select("i", ((F.col("i") + F.when(F.col("i") % 20 == 0, 1).otherwise(0)) % 50).alias("kb"))
    f = a.join(b, "i", "full")
    n = f.agg(F.count_if(F.col("ka") == F.col("kb")).alias("agree"))
    both = F.col("ka").isNotNull() & F.col("kb").isNotNull()
    return f.join(F.broadcast(n)).select("i", F.coalesce(F.when(F.col("ka") == F.col("kb"), F.col("ka")).when(both, None).when(F.col("agree") >= 3, F.coalesce("ka", "kb")), F.lit(-1)).alias("k"))


@query("""WITH s AS (SELECT s_suppkey, s_nationkey, CAST(floor(s_acctbal / 1000) AS BIGINT) AS year FROM supplier), u AS (SELECT s_nationkey, year, count(*) AS n, min(s_suppkey) AS key FROM s GROUP BY 1, 2)
  SELECT s_nationkey, year, CASE WHEN n = 1 THEN key ELSE -1 END AS key, CASE WHEN n = 1 THEN 'ok' ELSE 'ambiguous' END AS status FROM u""")
def j12_unique_or_refuse(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", F.floor(F.col("s_acctbal") / 1000).alias("year"))
    u = s.groupBy("s_nationkey", "year").agg(F.count("*").alias("n"), F.min("s_suppkey").alias("key"))
    return u.select("s_nationkey", "year", F.when(F.col("n") == 1, F.col("key")).otherwise(-1).alias("key"), F.when(F.col("n") == 1, "ok").otherwise("ambiguous").alias("status"))


@query("""WITH e AS (SELECT c_custkey AS id, c_name AS txt, 'c' || (c_custkey % 5) AS v FROM customer WHERE c_custkey % 4 <> 0), g AS (SELECT c_custkey + CASE WHEN c_custkey % 6 = 0 THEN 1 ELSE 0 END AS id, c_name AS txt, 'c' || (c_custkey % 5) AS expect FROM customer)
  SELECT g.txt, CASE WHEN a.id IS NOT NULL THEN 'exact' WHEN b.id IS NOT NULL THEN 'drifted' ELSE 'missing' END AS how, CASE WHEN coalesce(a.v, b.v) IS NULL THEN 'missing' WHEN coalesce(a.v, b.v) = expect THEN 'pass' ELSE 'fail' END AS result
  FROM g LEFT JOIN e a ON a.id = g.id AND a.txt = g.txt LEFT JOIN e b ON b.txt = g.txt""")
def j16_a28_regression_scores(spark, sf_dir):
    """Expected verdicts find their claim by id and text, else by text alone (drifted), else it is missing."""
    c = read(spark, sf_dir, "customer")
    v = F.concat(F.lit("c"), F.col("c_custkey") % 5)
    e = c.where("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("txt"), v.alias("v"))
    g = c.select((F.col("c_custkey") + F.when(F.col("c_custkey") % 6 == 0, 1).otherwise(0)).alias("id"), F.col("c_name").alias("txt"), v.alias("expect"))
    exact, by_text = e.withColumnRenamed("v", "va"), windows.first_of(e, ["txt"], F.col("id")).select("txt", F.col("v").alias("vb"))
    rows = g.join(exact, ["id", "txt"], "left").join(by_text, "txt", "left")
    found = F.coalesce("va", "vb")
    return rows.select("txt", F.when(F.col("va").isNotNull(), "exact").when(F.col("vb").isNotNull(), "drifted").otherwise("missing").alias("how"), F.when(found.isNull(), "missing").when(found == F.col("expect"), "pass").otherwise("fail").alias("result"))


@query("""WITH a AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS s FROM lineitem), x AS (SELECT o FROM a GROUP BY o HAVING count(*) = 1) SELECT s, count(*) AS sole FROM a SEMI JOIN x USING (o) GROUP BY s
  UNION ALL SELECT s_suppkey, 0 FROM supplier ANTI JOIN (SELECT s AS s_suppkey FROM a SEMI JOIN x USING (o)) USING (s_suppkey)""")
def s01_s03_s04_set_operations(spark, sf_dir):
    """Sources that are some claim's only one, and with 0 those that never are."""
    a = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_suppkey").alias("s")).distinct()
    sole = a.join(a.groupBy("o").count().where("count = 1"), "o", "left_semi").groupBy("s").agg(F.count("*").alias("sole"))
    rest = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("s")).join(sole, "s", "left_anti").withColumn("sole", F.lit(0).cast("long"))
    return sole.unionByName(rest)


@query("""WITH n AS (SELECT o_custkey AS paper, CASE o_orderstatus WHEN 'F' THEN 'cites' ELSE 'cited_by' END AS relation, o_totalprice > 200000 AS influential FROM orders)
  SELECT paper, CASE WHEN count(DISTINCT relation) > 1 THEN 'both' ELSE min(relation) END AS relation, bool_or(influential) AS influential FROM n GROUP BY paper""")
def s02_neighbour_union(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    n = o.select(F.col("o_custkey").alias("paper"), F.when(F.col("o_orderstatus") == "F", "cites").otherwise("cited_by").alias("relation"), (F.col("o_totalprice") > 200000).alias("influential"))
    return n.groupBy("paper").agg(F.when(F.min("relation") != F.max("relation"), "both").otherwise(F.min("relation")).alias("relation"), F.bool_or("influential").alias("influential"))


@query("""WITH u AS (SELECT DISTINCT vec_id + d AS j FROM embeddings, (VALUES (-1), (0), (1)) t(d) WHERE vec_id % 30 = 0) SELECT vec_id AS claim FROM embeddings ANTI JOIN (SELECT j AS vec_id FROM u) USING (vec_id)""")
def a07_a08_omitted_claims(spark, sf_dir):
    """Claims none of whose evidence lies within one sentence of a used one."""
    e = read(spark, sf_dir, "embeddings").select("vec_id")
    used = e.where("vec_id % 30 = 0").select(F.explode(F.sequence(F.col("vec_id") - 1, F.col("vec_id") + 1)).alias("vec_id")).distinct()
    return e.join(used, "vec_id", "left_anti").select(F.col("vec_id").alias("claim"))


# JSON answers

RAW = """SELECT event_id, CASE event_id % 6 WHEN 0 THEN '{{"supported": true, "reason": "r' || event_id || '"}}' WHEN 1 THEN 'Here: ```json' || chr(10) || '{{"supported": "false", "reason": "no"}}```' WHEN 2 THEN 'text {{"supported": false, "reason": "x"}} more'
  WHEN 3 THEN '{{"supported": true, "reason": "cut of' WHEN 4 THEN 'nothing' END AS raw FROM {events}"""


@query("""SELECT event_id, event_id % 6 IN (0, 3) AS supported, CASE event_id % 6 WHEN 0 THEN 'r' || event_id WHEN 1 THEN 'no' WHEN 2 THEN 'x' WHEN 3 THEN 'cut of' WHEN 4 THEN 'unparseable: treated as unsupported' ELSE 'no response: treated as unsupported' END AS reason FROM events""")
def n01_n02_support_parse(spark, sf_dir):
    raw = spark.sql(RAW, events=read(spark, sf_dir, "events"))
    supported, reason = judge.parse_support(F.col("raw"))
    return raw.select("event_id", supported.alias("supported"), reason.alias("reason"))


@query("SELECT event_id, json_extract_string(props, '$.page') AS page, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CASE WHEN event_type IN ('view', 'click') THEN event_type END AS kind FROM events")
def n05_n09_json_fields(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return e.select("event_id", F.get_json_object("props", "$.page").alias("page"), F.get_json_object("props", "$.k").cast("long").alias("k"), F.when(F.col("event_type").isin("view", "click"), F.col("event_type")).alias("kind"))


@query("""WITH w AS (SELECT doc_id, string_split(text, ' ') AS a FROM documents) SELECT doc_id, array_to_string(a, ' ') AS abstract FROM w""")
def c17_abstract_from_inverted_index(spark, sf_dir):
    """Words with their positions, as an inverted index stores them, put back in order."""
    w = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", " ")).alias("pos", "word"))
    index = w.groupBy("doc_id", "word").agg(F.collect_list("pos").alias("at"))
    back = index.select("doc_id", "word", F.explode("at").alias("pos")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("s"))
    return back.select("doc_id", F.array_join("s.word", " ").alias("abstract"))


@query("""SELECT r_regionkey AS region, row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey) AS position, CAST(regexp_extract(n_name, '(\\d+)\\s*$', 1) AS VARCHAR) AS number, n_name AS raw FROM region JOIN nation ON n_regionkey = r_regionkey""")
def c15_deposited_references(spark, sf_dir):
    n = read(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("refs"))
    rows = n.select("region", F.posexplode("refs").alias("p", "r"))
    return rows.select("region", (F.col("p") + 1).cast("long").alias("position"), F.regexp_extract("r.n_name", r"(\d+)\s*$", 1).alias("number"), F.col("r.n_name").alias("raw"))
