"""Queries of the grounding chain (V, R15, P13): stages over tables of answers that both engines derive alike."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import chain, retrieve, windows
from .registry import query, read
from .text_queries import SENTENCES, sentence_rows

THREE = "documents CROSS JOIN (VALUES (0), (1), (2)) AS v(k)"
VOTES = "SELECT doc_id AS claim, k AS vote_no, {0} AS supported FROM documents CROSS JOIN (VALUES (1), (2), (3)) AS v(k)"


def answers(spark, sf_dir, sql: str):
    """Rows of an input that SQL derives from the documents' ids; the oracle reads the same text."""
    return spark.sql(sql.replace("documents", "{documents}"), documents=read(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"))


JUDGED = f"SELECT doc_id AS claim, k AS pid, k AS ord, (doc_id + k) % 7 = 0 AS supported, 'j' || k AS reason FROM {THREE} WHERE doc_id % 11 <> 0"
READ = f"SELECT doc_id AS claim, k AS pid, k AS ord, (doc_id * 3 + k) % 8 = 0 AS supported, (doc_id + k) % 3 <> 0 OR doc_id % 5 = 1 AS has_sentence, 'r' || k AS reason FROM {THREE} WHERE doc_id % 11 <> 0"
NAMED = f"SELECT doc_id AS claim, 'e' || e AS entity, k AS pid, (doc_id + e * 2 + k) % 5 <> 0 AND (doc_id % 9 <> 2 OR e = 0) AS held FROM {THREE} CROSS JOIN (VALUES (0), (1)) AS w(e) WHERE doc_id % 4 <> 0 AND doc_id % 11 <> 0"
COMBINED = "SELECT doc_id AS claim, doc_id % 2 = 0 AS supported, 'c' AS reason FROM documents"


@query(f"""WITH judged AS ({JUDGED}), rd AS ({READ}), named AS ({NAMED}), combined AS ({COMBINED}),
  missing AS (SELECT claim, pid FROM named WHERE NOT held), gone AS (SELECT claim, string_agg(DISTINCT entity, '; ' ORDER BY entity) AS names FROM named WHERE NOT held GROUP BY 1),
  g AS (SELECT rd.*, EXISTS (SELECT 1 FROM missing m WHERE m.claim = rd.claim AND m.pid = rd.pid) AS bad FROM rd),
  f AS (SELECT claim, min(ord) FILTER (supported AND NOT bad) AS proof, count(*) FILTER (supported AND bad) AS dropped, count(*) FILTER (has_sentence) AS n, min(ord) FILTER (has_sentence) AS sent, min(ord) AS first FROM g GROUP BY 1),
  u AS (SELECT DISTINCT claim FROM (SELECT n.claim, n.entity FROM named n JOIN rd ON rd.claim = n.claim AND rd.pid = n.pid AND rd.has_sentence GROUP BY 1, 2 HAVING NOT bool_or(held))),
  b AS (SELECT DISTINCT claim FROM (SELECT claim, entity FROM named GROUP BY 1, 2 HAVING NOT bool_or(held))),
  j AS (SELECT claim, min(ord) FILTER (supported) AS direct FROM judged GROUP BY 1),
  x AS (SELECT d.doc_id AS claim, j.claim IS NOT NULL AS seen, direct, proof, dropped, n, sent, first, n >= 2 AND d.doc_id NOT IN (SELECT claim FROM u) AS together, names, c.supported AS ok, d.doc_id IN (SELECT claim FROM b) AS blocked
    FROM documents d LEFT JOIN j ON j.claim = d.doc_id LEFT JOIN f ON f.claim = d.doc_id LEFT JOIN gone ON gone.claim = d.doc_id JOIN combined c ON c.claim = d.doc_id)
  SELECT claim, CASE WHEN NOT seen THEN 'unsupported' WHEN direct IS NOT NULL OR proof IS NOT NULL OR (together AND ok) THEN 'supported' ELSE 'unsupported' END AS verdict,
    CASE WHEN NOT seen THEN 'none' WHEN direct IS NOT NULL THEN 'llm' WHEN proof IS NULL AND together THEN 'combined_fulltext' ELSE 'llm_fulltext' END AS method,
    CASE WHEN NOT seen THEN 'no_source_sentences' WHEN direct IS NOT NULL THEN 'j' || direct WHEN proof IS NOT NULL THEN 'r' || proof WHEN together THEN 'c' WHEN dropped > 0 OR n >= 2 THEN '''' || coalesce(names, '') || ''' is never mentioned in the cited source''s text' ELSE 'r' || coalesce(sent, first) END AS reason, blocked FROM x""")
def v04_evaluate_chain(spark, sf_dir):
    tables = [answers(spark, sf_dir, sql) for sql in ("SELECT doc_id AS claim FROM documents", JUDGED, READ, NAMED, COMBINED)]
    return chain.evaluate(*tables)


PARTS = "SELECT doc_id AS claim, k, 'part ' || k AS part FROM documents CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5)) AS v(k) WHERE k <= doc_id % 6"
PROBES = "SELECT doc_id AS claim, k, p AS pid, p AS ord, (doc_id + k * 2 + p) % 5 <> 0 AND doc_id % 13 <> k AND doc_id % 17 <> 1 AS supported FROM documents CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5)) AS v(k) CROSS JOIN (VALUES (0), (1)) AS w(p)"
RESCUE_VOTES = VOTES.format("doc_id % 4 <> 1 OR k <> 2")


@query(f"""WITH parts AS ({PARTS}), probes AS ({PROBES}), votes AS ({RESCUE_VOTES}),
  r AS (SELECT p.claim, p.k, p.part, EXISTS (SELECT 1 FROM probes q WHERE q.claim = p.claim AND q.k = p.k AND q.supported) AS hit FROM parts p WHERE p.k < 4 AND p.claim % 2 = 1),
  s AS (SELECT claim, coalesce(string_agg(part, '|' ORDER BY k) FILTER (hit), '') AS found, coalesce(string_agg(part, '|' ORDER BY k) FILTER (NOT hit), '') AS missing FROM r GROUP BY 1)
  SELECT claim, found, missing, missing = '' AND (SELECT bool_and(supported) FROM votes v WHERE v.claim = s.claim) AS flip FROM s WHERE found <> ''""")
def v05_component_rescue(spark, sf_dir):
    """Claims with an odd number are open; every part is sought in two sources."""
    tables = [answers(spark, sf_dir, sql) for sql in ("SELECT doc_id AS claim FROM documents WHERE doc_id % 2 = 1", PARTS, PROBES, RESCUE_VOTES)]
    got = chain.component_rescue(*tables)
    return got.select("claim", F.array_join("found", "|").alias("found"), F.array_join("missing", "|").alias("missing"), "flip")


FIRST = "SELECT doc_id AS claim, doc_id % 3 = 0 AS supported FROM documents"
SECOND = "SELECT doc_id AS claim, k AS vote_no, doc_id % 7 = 0 AND k = 2 AS supported, CASE WHEN doc_id % 8 = 1 THEN 'Nothing of it.' ELSE 'The passage does not state that part ' || (doc_id % 4) || ' grew, nor that the rate fell.' END AS reason FROM documents CROSS JOIN (VALUES (1), (2), (3)) AS v(k) WHERE doc_id % 5 <> 0"
FOUND = "SELECT doc_id AS claim, 'part ' || (doc_id % 4) || ' grew' AS part, 0 AS pid, doc_id % 2 = 0 AS supported FROM documents UNION ALL SELECT doc_id, 'the rate fell', 1, doc_id % 4 < 2 FROM documents"


@query("""SELECT doc_id AS claim, doc_id % 5 <> 0 AS escalated, CASE WHEN doc_id % 5 <> 0 THEN '3-0' ELSE '' END AS votes,
    CASE WHEN doc_id % 5 = 0 OR doc_id % 8 = 1 THEN '' ELSE concat_ws('|', CASE WHEN doc_id % 2 = 1 THEN 'part ' || (doc_id % 4) || ' grew' END, CASE WHEN doc_id % 4 >= 2 THEN 'the rate fell' END) END AS parts
  FROM documents WHERE doc_id % 3 <> 0 AND (doc_id % 5 = 0 OR (doc_id % 7 <> 0 AND (doc_id % 8 = 1 OR doc_id % 2 = 1 OR doc_id % 4 >= 2)))""")
def v08_partial_support(spark, sf_dir):
    """Claims that the first round doubts, unless a vote of the second or a probe of every named part speaks for them."""
    tables = [answers(spark, sf_dir, sql) for sql in ("SELECT doc_id AS claim FROM documents", FIRST, SECOND, FOUND)]
    return chain.partial_support(*tables).withColumn("parts", F.array_join("parts", "|"))


CANDIDATES = "SELECT doc_id AS claim, k AS number, k % 2 AS pid, 'sentence ' || k AS sentence FROM documents CROSS JOIN (VALUES (1), (2), (3), (4)) AS v(k)"
PICKS = "SELECT doc_id AS claim, k, 'part ' || k AS part, CASE (doc_id + k) % 4 WHEN 0 THEN '1,[2],x,9' WHEN 1 THEN 'none' WHEN 2 THEN ' 4 ' ELSE '3,1,2,4' END AS picks FROM documents CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5), (6), (7), (8), (9), (10), (11), (12), (13), (14), (15)) AS v(k) WHERE k <= doc_id % 16"
SOUGHT = "SELECT doc_id AS claim, 'part ' || k AS part, 7 AS pid, 'found ' || k AS sentence FROM documents CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5), (6), (7), (8), (9)) AS v(k) WHERE (doc_id + k) % 3 <> 0"


@query(f"""WITH candidates AS ({CANDIDATES}), parts AS ({PICKS}), sought AS ({SOUGHT}),
  l AS (SELECT claim, k, part, list_filter(list_transform(string_split(picks, ','), lambda x: TRY_CAST(regexp_replace(x, '[\\[\\]\\s]', '', 'g') AS INTEGER)), lambda x: x BETWEEN 1 AND 4) AS p FROM parts),
  e AS (SELECT claim, k, part, unnest(p) AS number, unnest(range(len(p))) AS pos FROM l), o AS (SELECT *, row_number() OVER (PARTITION BY claim ORDER BY k, pos) - 1 AS ord FROM e),
  b AS (SELECT claim, k, part, row_number() OVER (PARTITION BY claim ORDER BY k) - 1 AS n FROM l WHERE len(p) = 0)
  SELECT o.claim, o.part, ord, c.pid, c.sentence FROM o JOIN candidates c ON c.claim = o.claim AND c.number = o.number WHERE ord < 12
  UNION ALL SELECT b.claim, b.part, 12 + n, s.pid, s.sentence FROM b LEFT JOIN sought s ON s.claim = b.claim AND s.part = b.part AND n < 3""")
def v10_covering_set(spark, sf_dir):
    """Up to sixteen parts a claim, with picks written as models write them."""
    parts = answers(spark, sf_dir, PICKS).withColumn("picks", F.split("picks", ","))
    got = chain.covering_set(parts, answers(spark, sf_dir, CANDIDATES), answers(spark, sf_dir, SOUGHT))
    return got.withColumn("ord", F.col("ord").cast("long"))


COVERED = "SELECT doc_id AS claim, k AS k, 'alpha' || k || ' beta' || k AS part, k * 2 + i AS pick, 'shown ' || k AS sentence, k = 1 AS specific FROM documents CROSS JOIN (VALUES (0), (1), (2), (3)) AS v(k) CROSS JOIN (VALUES (1), (2)) AS w(i)"
KEEPS = "SELECT doc_id AS claim, n AS vote_no, 'alpha' || k || ' beta' || k AS part, k * 2 + 1 + (doc_id + k + n) % 5 AS keep FROM documents CROSS JOIN (VALUES (0), (1), (2)) AS v(k) CROSS JOIN (VALUES (1), (2), (3)) AS w(n) WHERE doc_id % 6 <> 0 AND (n = 1 OR k = 1)"
FRESH = "SELECT doc_id AS claim, k, CASE k WHEN 0 THEN 'alpha0 beta0 again' ELSE 'gamma' || k || ' delta' END AS part FROM documents CROSS JOIN (VALUES (0), (1), (2), (3)) AS v(k)"
NAMES = "SELECT doc_id AS claim, k, CASE k WHEN 0 THEN 'Shown' ELSE 'Place' || k END AS part FROM documents CROSS JOIN (VALUES (0), (1), (2), (3)) AS v(k)"
HITS = "SELECT doc_id AS claim, 'alpha' || k || ' beta' || k AS part FROM documents CROSS JOIN (VALUES (0), (1), (2)) AS v(k) WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 'gamma1 delta' FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 'Place2' FROM documents"


@query(f"""WITH covered AS ({COVERED}), keeps AS ({KEEPS}), hits AS ({HITS}),
  v AS (SELECT c.*, c.claim % 6 <> 0 AS heard, count(q.vote_no) AS seen, count(*) FILTER (q.keep = c.pick) AS yes, count(*) FILTER (q.vote_no = 1) AS one, count(*) FILTER (q.vote_no = 1 AND q.keep = c.pick) AS one_yes FROM covered c LEFT JOIN keeps q ON q.claim = c.claim AND q.part = c.part GROUP BY ALL),
  s AS (SELECT *, CASE WHEN NOT heard THEN true WHEN specific THEN yes + 3 - seen >= 2 ELSE one = 0 OR one_yes > 0 END AS stays FROM v),
  lost AS (SELECT claim, part, row_number() OVER (PARTITION BY claim ORDER BY k) AS n FROM s GROUP BY claim, part, k HAVING NOT bool_or(stays))
  SELECT claim, part, pick, 'kept' AS state FROM s WHERE stays
  UNION ALL SELECT claim, part, NULL, CASE WHEN n <= 2 AND EXISTS (SELECT 1 FROM hits h WHERE h.claim = lost.claim AND h.part = lost.part) THEN 'found' ELSE 'uncovered' END FROM lost
  UNION ALL SELECT doc_id, 'bare', NULL, 'uncovered' FROM documents
  UNION ALL SELECT doc_id, 'gamma1 delta', NULL, CASE WHEN doc_id % 3 = 0 THEN 'found' ELSE 'uncovered' END FROM documents WHERE doc_id % 6 <> 0 UNION ALL SELECT doc_id, 'gamma2 delta', NULL, 'uncovered' FROM documents WHERE doc_id % 6 <> 0
  UNION ALL SELECT doc_id, 'Place1', NULL, 'uncovered' FROM documents WHERE doc_id % 6 <> 0 UNION ALL SELECT doc_id, 'Place2', NULL, 'found' FROM documents WHERE doc_id % 6 <> 0""")
def v11_pick_audit(spark, sf_dir):
    """Four parts of two picks; the second names something specific and is voted on thrice, the fourth is not reviewed."""
    uncovered = answers(spark, sf_dir, "SELECT doc_id AS claim, 9 AS k, 'bare' AS part FROM documents")
    votes = answers(spark, sf_dir, KEEPS).withColumn("keep", F.array("keep"))
    return chain.audit_picks(answers(spark, sf_dir, COVERED), uncovered, votes, answers(spark, sf_dir, FRESH), answers(spark, sf_dir, NAMES), answers(spark, sf_dir, HITS))


@query(rf"""WITH s AS (SELECT doc_id, j, text, length(text) % 17 AS score, length(trim(text)) < 8 OR (len(string_split(text, ' ')) < 4 AND NOT regexp_matches(text, '\d')) AS bad FROM {SENTENCES}),
  h AS (SELECT doc_id, string_agg(text, ' ' ORDER BY j) AS head FROM (SELECT * FROM s WHERE j < 4 AND NOT bad QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY j) <= 2) GROUP BY 1),
  b AS (SELECT s.doc_id, string_agg(text, ' ' ORDER BY n) AS best FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, j) AS n FROM s) s LEFT JOIN h USING (doc_id) WHERE n <= 6 AND NOT bad AND NOT contains(coalesce(head, ''), text) GROUP BY 1),
  c AS (SELECT doc_id, 'Claims this source makes: ' || string_agg(text, ' ' ORDER BY n) AS made FROM (SELECT doc_id, lower(text) AS text, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, j) AS n FROM s WHERE j % 5 = 0) WHERE n <= 4 GROUP BY 1)
  SELECT doc_id, md5(concat_ws(' ', h.head, b.best, c.made)) AS context FROM h FULL JOIN b USING (doc_id) FULL JOIN c USING (doc_id)""")
def r15_escalated_context(spark, sf_dir):
    rows = sentence_rows(read(spark, sf_dir, "documents")).withColumn("score", F.length("text") % 17)
    made = rows.where("j % 5 = 0").withColumn("text", F.lower("text"))
    return chain.escalated_context(rows, rows, made, ["doc_id"]).select("doc_id", F.md5("context").alias("context"))


EXTRACTED = f"(SELECT doc_id AS claim, 0 AS pid, CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS attempt, j // 10 AS chunk, j AS pos, text, CASE WHEN j % 7 = 3 THEN -1 WHEN j % 9 = 4 THEN j - 1 ELSE j END AS j, round(abs(sin(j)), 9) AS cos, round(abs(cos(j)), 9) AS lex, j % 4 <> 1 AS keep FROM {SENTENCES} WHERE j % 2 = 0)"


@query(rf"""WITH x AS (SELECT *, CASE WHEN j >= 0 THEN CAST(j AS VARCHAR) ELSE lower(text) END AS key FROM {EXTRACTED} WHERE keep),
  o AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY claim, pid, key ORDER BY chunk, pos) = 1),
  r AS (SELECT *, row_number() OVER (PARTITION BY claim ORDER BY chunk, pos) AS ord, CASE WHEN j >= 0 THEN cos ELSE -1 END AS c, CASE WHEN j >= 0 THEN lex ELSE -1 END AS l FROM o),
  f AS (SELECT *, row_number() OVER (PARTITION BY claim ORDER BY c DESC, ord) - 1 AS rc, row_number() OVER (PARTITION BY claim ORDER BY l DESC, ord) - 1 AS rl FROM r),
  n AS (SELECT *, row_number() OVER (PARTITION BY claim ORDER BY round(1.0::DOUBLE / (5 + rc) + 1.0::DOUBLE / (5 + rl), 12) DESC, ord) AS n FROM f),
  w AS (SELECT doc_id AS pid0, j, string_agg(text, ' ') OVER (PARTITION BY doc_id ORDER BY j ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS win FROM {SENTENCES}),
  p AS (SELECT n.claim, n, n.j, text, CASE WHEN n.j >= 0 AND len(string_split(text, ' ')) < 4 THEN win ELSE text END AS part FROM n LEFT JOIN w ON w.pid0 = n.claim AND w.j = n.j WHERE n <= 8),
  d AS (SELECT claim, part, min(n) AS n FROM p GROUP BY 1, 2)
  SELECT claim, arg_min(p.j, p.n) AS j, md5(arg_min(text, p.n)) AS sentence, md5((SELECT string_agg(part, ' ' ORDER BY d.n) FROM d WHERE d.claim = p.claim)) AS passage FROM p GROUP BY claim""")
def v03_extraction_passages(spark, sf_dir):
    """Every second sentence as an extraction, some unmapped, some twice, some dropped by the gate; every fifth claim needed a second attempt."""
    rows = sentence_rows(read(spark, sf_dir, "documents"))
    j = F.col("j").cast("long")
    sents = rows.select(F.col("doc_id").alias("pid"), "j", windows.around("text", "doc_id", "j").alias("win"))
    mapped = F.when(j % 7 == 3, -1).when(j % 9 == 4, j - 1).otherwise(j)
    out = rows.where("j % 2 = 0").select(
        F.col("doc_id").alias("claim"), F.col("doc_id").alias("pid"), F.when(F.col("doc_id") % 5 == 0, 1).otherwise(0).alias("attempt"), F.floor(j / 10).alias("chunk"), j.alias("pos"), "text",
        mapped.alias("j"), F.round(F.abs(F.sin(j)), 9).alias("cos"), F.round(F.abs(F.cos(j)), 9).alias("lex"), (j % 4 != 1).alias("keep"),
    )
    got = chain.extraction_passages(out, sents)
    return got.select("claim", "j", F.md5("sentence").alias("sentence"), F.md5("passage").alias("passage"))


@query("""SELECT item_id, item_id % 6 NOT IN (1, 3, 5) AS keep FROM benchmark""")
def p13_membership_gate(spark, sf_dir):
    """A sentence mapped, unusable, verbatim, an echo of the claim, a condensation, and a quote with the claim's own words at its end."""
    k = F.col("item_id") % 6
    source = F.col("text")
    claim = F.concat(F.lit("Entirely other words that nobody wrote anywhere in a source at all, number "), F.col("item_id"), F.lit(" of them"))
    fused = F.concat(F.substring("text", 1, 60), F.lit(" words that nobody wrote anywhere in a source at all"))
    short = F.lit("The gist of what was said there, more or less in other wording")
    text = F.when(k == 0, short).when(k == 1, F.lit("x y")).when(k == 2, F.substring("text", 1, 90)).when(k == 3, claim).when(k == 4, short).otherwise(fused)
    rows = read(spark, sf_dir, "benchmark").select("item_id", text.alias("e"), F.when(k == 0, 3).otherwise(-1).alias("j"), claim.alias("claim"), source.alias("source"))
    return rows.select("item_id", chain.keep_extraction(F.col("e"), F.col("j"), F.col("claim"), F.col("source")).alias("keep"))


@query(rf"""WITH s AS (SELECT doc_id, j, text FROM {SENTENCES}), f AS (SELECT doc_id, j FROM s WHERE j % 20 = 6 AND doc_id % 3 <> 0),
  n AS (SELECT DISTINCT s.doc_id, s.j, s.text FROM f JOIN s ON s.doc_id = f.doc_id AND s.j BETWEEN f.j - 2 AND f.j + 2)
  SELECT doc_id AS claim, md5(string_agg(text, ' ' ORDER BY j)) AS passage, doc_id % 4 <> 1 AS flip FROM n GROUP BY doc_id""")
def v18_arbiter_rescue(spark, sf_dir):
    """An arbiter located every twentieth sentence; sources of every third claim do not name its subject."""
    rows = sentence_rows(read(spark, sf_dir, "documents")).withColumn("pid", F.col("doc_id"))
    located = rows.where("j % 20 = 6").select(F.col("doc_id").alias("claim"), "pid", "j")
    guarded = answers(spark, sf_dir, "SELECT doc_id AS claim, doc_id AS pid FROM documents WHERE doc_id % 3 = 0")
    got = chain.rescue_by_arbiter(located, rows.select("pid", "j", "text"), guarded, answers(spark, sf_dir, RESCUE_VOTES))
    return got.select("claim", F.md5("passage").alias("passage"), "flip")


@query(f"""WITH p AS (SELECT doc_id, 'Judge. ' || CASE WHEN doc_id % 2 = 0 THEN '{chain.ANSWER} now.' ELSE 'Answer.' END AS prompt, CASE doc_id % 3 WHEN 0 THEN 'From X (article dated 2019-02-15): a' WHEN 1 THEN 'From X (byline: A Lee; article dated 2019-02-15): a' ELSE 'From X: a' END AS passage FROM documents)
  SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN prompt WHEN doc_id % 2 = 0 THEN replace(prompt, '{chain.ANSWER}', '{chain.DATE_RULE.replace("'", "''")}' || chr(10) || chr(10) || '{chain.ANSWER}') ELSE prompt || chr(10) || chr(10) || '{chain.DATE_RULE.replace("'", "''")}' END AS prompt FROM p""")
def v20_date_rule(spark, sf_dir):
    k = F.col("doc_id")
    prompt = F.concat(F.lit("Judge. "), F.when(k % 2 == 0, F.lit(chain.ANSWER + " now.")).otherwise("Answer."))
    passage = F.when(k % 3 == 0, "From X (article dated 2019-02-15): a").when(k % 3 == 1, "From X (byline: A Lee; article dated 2019-02-15): a").otherwise("From X: a")
    return read(spark, sf_dir, "documents").select("doc_id", chain.inject_date_rule(prompt, passage).alias("prompt"))


@query("SELECT doc_id AS claim, CASE WHEN doc_id % 3 <> 0 AND doc_id % 4 <> 1 AND doc_id % 7 <> 0 THEN 'new ' || lang ELSE lang END AS text, doc_id % 3 <> 0 AND doc_id % 4 <> 1 AND doc_id % 7 <> 0 AS changed FROM documents")
def v22_claim_fixer(spark, sf_dir):
    """Rewrites count where something was extracted, two of three votes support them and they are not blank."""
    claims = answers(spark, sf_dir, "SELECT doc_id AS claim, lang AS text FROM documents")
    extracted = answers(spark, sf_dir, "SELECT doc_id AS claim, 'x' AS text FROM documents WHERE doc_id % 3 <> 0")
    rewrites = answers(spark, sf_dir, "SELECT doc_id AS claim, CASE WHEN doc_id % 7 = 0 THEN ' ' ELSE 'new ' || lang END AS rewrite FROM documents")
    return chain.rewrite_claims(claims, extracted, rewrites, answers(spark, sf_dir, VOTES.format("doc_id % 4 <> 1 OR k = 2")))


@query(rf"""WITH s AS (SELECT doc_id, j, text, string_agg(text, ' ') OVER (PARTITION BY doc_id ORDER BY j ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS wide FROM {SENTENCES}),
  c AS (SELECT doc_id, j // 25 AS chunk, max(length(text)) AS best, string_agg(text, ' ' ORDER BY j) AS body FROM s GROUP BY 1, 2), t AS (SELECT doc_id, arg_max(body, (best, -chunk)) AS body FROM c GROUP BY 1)
  SELECT doc_id, md5(wide || ' ' || body) AS passage, doc_id % 4 = 0 AS first, length(wide || ' ' || body) % 2 = 0 AS second, (doc_id % 4 = 0) <> (length(wide || ' ' || body) % 2 = 0) AS differs FROM s JOIN t USING (doc_id) WHERE j = 3""")
def v23_deep_check(spark, sf_dir):
    """A second verdict from the wide window of the pick and the best chunk of its source, beside the first one."""
    rows = sentence_rows(read(spark, sf_dir, "documents")).withColumn("wide", windows.around("text", "doc_id", "j", 4))
    chunks = rows.groupBy("doc_id", F.floor(F.col("j") / 25).alias("chunk")).agg(F.max(F.length("text")).alias("best"), F.array_join(F.array_sort(F.collect_list(F.struct("j", "text")))["text"], " ").alias("body"))
    top = chunks.groupBy("doc_id").agg(F.max_by("body", F.struct("best", -F.col("chunk"))).alias("body"))
    read_again = rows.where("j = 3").join(top, "doc_id").withColumn("passage", F.concat_ws(" ", "wide", "body"))
    first, second = F.col("doc_id") % 4 == 0, F.length("passage") % 2 == 0
    return read_again.select("doc_id", F.md5("passage").alias("passage"), first.alias("first"), second.alias("second"), (first != second).alias("differs"))
