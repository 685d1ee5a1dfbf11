"""Queries of retrieval, ranking, windows and graphs (R, W, J05, D)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import graph, retrieve, vectors, windows
from .registry import query, read
from .text_queries import SENTENCES, sentence_rows

TOKENS = r"list_distinct(list_transform(regexp_extract_all(lower({0}), '\d{{1,3}}(?:[ ,.]\d{{3}})+|\d+(?:[.,]\d+)?%?|[a-z]{{4,}}'), lambda x: CASE WHEN regexp_full_match(x, '\d{{1,3}}(?:[ ,.]\d{{3}})+') THEN regexp_replace(x, '[ ,.]', '', 'g') ELSE x END))"
LEX = f"""claims AS (SELECT item_id, text AS claim_text, item_id % 40 AS src FROM benchmark),
  texts AS (SELECT doc_id % 40 AS src, doc_id, text, n_chars FROM documents),
  ct AS (SELECT item_id, src, unnest({TOKENS.format('claim_text')}) AS tok FROM claims), tt AS (SELECT src, doc_id, unnest({TOKENS.format('text')}) AS tok FROM texts),
  hits AS (SELECT * FROM ct JOIN tt USING (src, tok)), df AS (SELECT item_id, src, tok, count(*) AS df FROM hits GROUP BY ALL), n AS (SELECT src, count(*) AS n FROM texts GROUP BY src),
  lx AS (SELECT item_id, src, doc_id, sum(ln(1 + n / (1 + df))) AS lex FROM hits JOIN df USING (item_id, src, tok) JOIN n USING (src) GROUP BY ALL),
  sc AS (SELECT c.item_id, x.src, x.doc_id, x.n_chars, round(coalesce(l.lex, 0), 6) AS lex FROM claims c JOIN texts x USING (src) LEFT JOIN lx l ON l.item_id = c.item_id AND l.src = x.src AND l.doc_id = x.doc_id)"""


def _lexical(spark, sf_dir):
    claims = read(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("claim_text"), (F.col("item_id") % 40).alias("src"))
    texts = read(spark, sf_dir, "documents").select((F.col("doc_id") % 40).alias("src"), "doc_id", "text", "n_chars")
    scored = retrieve.lexical_scores(claims, texts, "src", "item_id", "doc_id").withColumn("lex", F.round("lex", 6))
    return scored.join(texts.select("src", "doc_id", "n_chars"), ["src", "doc_id"])


@query(f"WITH {LEX} SELECT item_id, doc_id, lex FROM sc")
def r07_j02_lexical_idf(spark, sf_dir):
    return _lexical(spark, sf_dir).select("item_id", "doc_id", "lex")


@query(f"""WITH {LEX}, r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY n_chars DESC, doc_id) - 1 AS rc, row_number() OVER (PARTITION BY item_id ORDER BY lex DESC, doc_id) - 1 AS rl FROM sc),
  f AS (SELECT item_id, doc_id, 1.0::DOUBLE / (5 + rc) + 1.0::DOUBLE / (5 + rl) AS rrf FROM r) SELECT item_id, doc_id, round(rrf, 9) AS rrf FROM f QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY round(rrf, 9) DESC, doc_id) <= 6""")
def r08_r09_r10_w04_hybrid_topk(spark, sf_dir):
    fused = retrieve.fuse(_lexical(spark, sf_dir), ["item_id"], "doc_id", "n_chars", "lex").withColumn("rrf", F.round("rrf", 9))
    return fused.withColumn("rank", retrieve.rank(["item_id"], F.col("rrf").desc(), F.col("doc_id"))).where("rank < 6").select("item_id", "doc_id", "rrf")


COS = "WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), p AS (SELECT a.vec_id AS claim, a.label AS own, b.label AS src, b.vec_id AS j, round(list_cosine_similarity(a.v, b.v), 9) AS cos FROM e a JOIN e b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)"


def _cosines(spark, sf_dir):
    """Every twentieth vector as a claim against all others; ``src`` is a source."""
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", "embedding")
    pairs = vectors.tiled_cosines(rows.where("id % 20 = 0"), rows)  # the claims are the stated query set
    return pairs.select(F.col("a").alias("claim"), "own", "src", F.col("b").alias("j"), F.round("cos", 9).alias("cos"))


@query(COS + " SELECT claim, src, j, round(cos, 6) AS cos FROM p WHERE own = src")
def f26_r02_r03_cosine(spark, sf_dir):
    """A claim meets its own source's sentences only, through the join on the source."""
    e = read(spark, sf_dir, "embeddings")
    claims = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("claim"), F.col("label").alias("src"), F.col("embedding").alias("va"))
    pairs = claims.join(e.select(F.col("vec_id").alias("j"), F.col("label").alias("src"), F.col("embedding").alias("vb")), "src").where("claim <> j")
    return pairs.select("claim", "src", "j", F.round(F.round(retrieve.cosine(F.col("va"), F.col("vb")), 9), 6).alias("cos"))


@query(COS + ", r AS (SELECT *, row_number() OVER (PARTITION BY claim, src ORDER BY cos DESC, j) AS rn FROM p) SELECT claim, src, j, rn - 1 AS rank FROM r WHERE rn <= 3 AND cos >= 0.25")
def r04_candidate_topk(spark, sf_dir):
    got = retrieve.top_with_floor(_cosines(spark, sf_dir), ["claim", "src"], "cos", "j", 3, 0.25)
    return got.select("claim", "src", "j", F.col("rank").cast("long").alias("rank"))


@query(COS + """, r AS (SELECT *, row_number() OVER (PARTITION BY claim, src ORDER BY cos DESC, j) AS rn, max(cos) OVER (PARTITION BY claim, src) AS best FROM p)
  SELECT claim, src, j FROM r WHERE (cos >= 0.2 AND rn <= 3) OR (rn = 1 AND best < 0.2)""")
def r16_evidence_link(spark, sf_dir):
    return retrieve.link_evidence(_cosines(spark, sf_dir), ["claim", "src"], "cos", "j", 0.2).select("claim", "src", "j")


@query(COS + " SELECT j, round(max(cos), 4) AS relevance FROM p GROUP BY j")
def r17_omitted_ranking(spark, sf_dir):
    return _cosines(spark, sf_dir).groupBy("j").agg(F.round(F.max("cos"), 4).alias("relevance")).orderBy(F.col("relevance").desc_nulls_last(), "j")


@query(COS + """, r AS (SELECT *, row_number() OVER (PARTITION BY claim, src ORDER BY cos DESC, j) AS rn FROM p WHERE own <> src), m AS (SELECT *, row_number() OVER (PARTITION BY claim ORDER BY cos DESC, j) AS k FROM r WHERE rn <= 3)
  SELECT claim, src, j, k FROM m WHERE k <= 3""")
def r18_j03_alternatives(spark, sf_dir):
    """The best three of other sources' claims: three of each source, then three of all."""
    others = _cosines(spark, sf_dir).where("own <> src")
    each = others.withColumn("rn", retrieve.rank(["claim", "src"], F.col("cos").desc(), F.col("j"))).where("rn < 3")
    return each.withColumn("k", (retrieve.rank(["claim"], F.col("cos").desc(), F.col("j")) + 1).cast("long")).where("k <= 3").select("claim", "src", "j", "k")


@query(COS + """, s AS (SELECT claim, src, max(cos) AS best FROM p WHERE own <> src GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY claim ORDER BY best DESC, src) AS k FROM s WHERE best >= 0.3)
  SELECT claim, src, round(best, 6) AS best FROM r WHERE k <= 2""")
def r19_component_hunt(spark, sf_dir):
    best = _cosines(spark, sf_dir).where("own <> src").groupBy("claim", "src").agg(F.max("cos").alias("best")).where("best >= 0.3")
    return best.withColumn("k", retrieve.rank(["claim"], F.col("best").desc(), F.col("src"))).where("k < 2").select("claim", "src", F.round("best", 6).alias("best"))


@query(COS + """, c AS (SELECT claim, j // 25 AS chunk, max(cos) AS cos, max(CASE WHEN src = own THEN cos ELSE 0 END) AS lex, count(*) AS n FROM p GROUP BY ALL),
  r AS (SELECT *, count(*) OVER (PARTITION BY claim) AS size, sum(n) OVER (PARTITION BY claim) AS total, row_number() OVER (PARTITION BY claim ORDER BY cos DESC, chunk) AS rc, row_number() OVER (PARTITION BY claim ORDER BY lex DESC, chunk) AS rl FROM c)
  SELECT claim, chunk FROM r WHERE size <= 6 OR rc <= 6 OR (rl <= greatest(2, least(8, total // 40)) AND lex > 0)""")
def r11_chunk_gate(spark, sf_dir):
    lex = F.max(F.when(F.col("src") == F.col("own"), F.col("cos")).otherwise(0.0))
    chunks = _cosines(spark, sf_dir).groupBy("claim", F.floor(F.col("j") / 25).alias("chunk")).agg(F.max("cos").alias("cos"), lex.alias("lex"), F.count("*").alias("n"))
    chunks = chunks.withColumn("total", F.sum("n").over(Window.partitionBy("claim")))
    return retrieve.gate_chunks(chunks, ["claim"], "total").select("claim", "chunk")


@query(rf"""WITH q AS (SELECT item_id, text AS quote_text, item_id % 40 AS src FROM benchmark), s AS (SELECT doc_id % 40 AS src, doc_id * 100000 + j AS j, text FROM {SENTENCES}),
  qs AS (SELECT item_id, src, lower(list_filter(string_split(regexp_replace(trim(regexp_replace(quote_text, '\s+', ' ', 'g')), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')[1]) AS a FROM q),
  p AS (SELECT item_id, j, a, lower(text) AS b, list_distinct(string_split(a, ' ')) AS wa, list_distinct(string_split(lower(text), ' ')) AS wb FROM qs JOIN s USING (src)),
  c AS (SELECT item_id, j, CASE WHEN a = b THEN 2.0 WHEN (contains(a, b) OR contains(b, a)) AND least(length(a), length(b)) >= 20 THEN 0.6 + 0.4 * least(length(a), length(b)) / greatest(length(a), length(b)) ELSE len(list_intersect(wa, wb)) / len(list_distinct(list_concat(wa, wb))) END AS score FROM p)
  SELECT item_id, j, round(score, 6) AS score FROM c WHERE score >= 0.6 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, j) = 1""")
def r13_map_to_sentence(spark, sf_dir):
    quotes = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("quote"), (F.col("item_id") % 40).alias("src"), F.element_at(t.sentences(F.col("text")), 1).alias("quote_text"))
    sents = sentence_rows(read(spark, sf_dir, "documents")).select((F.col("doc_id") % 40).alias("src"), (F.col("doc_id") * 100000 + F.col("j")).alias("j"), "text")
    got = retrieve.map_to_sentence(quotes, sents, "src")
    return got.select(F.col("quote").alias("item_id"), "j", F.round("score", 6).alias("score"))


@query(r"""WITH q AS (SELECT item_id, regexp_replace(lower(text), '[^a-z0-9]+', '', 'g') AS k FROM benchmark), d AS (SELECT doc_id, regexp_replace(lower(text), '[^a-z0-9]+', '', 'g') AS body FROM documents)
  SELECT d.doc_id, q.item_id, instr(d.body, substr(q.k, 1, 60)) > 0 AS found FROM d JOIN q ON length(q.k) >= 20 AND q.item_id % 8 = d.doc_id % 8""")
def v16_j04_quote_gate(spark, sf_dir):
    """Does the beginning of a quote, as letters and digits, occur in the cited text? One equi key restricts the pairs."""
    quotes = read(spark, sf_dir, "benchmark").select("item_id", t.charstream(F.col("text")).alias("k"), (F.col("item_id") % 8).alias("cited"))
    docs = read(spark, sf_dir, "documents").select("doc_id", t.charstream(F.col("text")).alias("body"), (F.col("doc_id") % 8).alias("cited"))
    return docs.join(quotes.where(F.length("k") >= 20), "cited").select("doc_id", "item_id", F.contains(F.col("body"), F.substring("k", 1, 60)).alias("found"))


@query("SELECT conv_id, turn, string_agg(text, ' ') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS win FROM conversations")
def w01_evidence_window(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", windows.around("text", "conv_id", "turn").alias("win"))


@query(rf"""WITH s AS (SELECT doc_id, j FROM {SENTENCES} WHERE j < 12 AND NOT (length(text) < 8 OR (len(string_split(text, ' ')) < 4 AND NOT regexp_matches(text, '\d'))))
  SELECT doc_id, j FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY j) <= 6""")
def w02_lead_frame(spark, sf_dir):
    lead = sentence_rows(read(spark, sf_dir, "documents")).where(F.col("j") < 12).where(~t.degenerate(F.col("text")))
    return lead.withColumn("n", retrieve.rank(["doc_id"], F.col("j"))).where("n < 6").select("doc_id", "j")


@query(rf"""WITH u AS (SELECT doc_id, j, CASE WHEN j - lag(j) OVER (PARTITION BY doc_id ORDER BY j) > 8 THEN 1 ELSE 0 END AS far FROM {SENTENCES} WHERE text LIKE '%of%'),
  g AS (SELECT *, sum(far) OVER (PARTITION BY doc_id ORDER BY j ROWS UNBOUNDED PRECEDING) AS s FROM u)
  SELECT doc_id, min(j) AS lo, max(j) AS hi, count(*) AS n, max(j) - min(j) + 1 > 30 AS too_long FROM g GROUP BY doc_id, s""")
def w03_reading_spans(spark, sf_dir):
    used = sentence_rows(read(spark, sf_dir, "documents")).where(F.contains("text", F.lit("of"))).select("doc_id", "j")
    return windows.spans(used, ["doc_id"], "j").withColumn("too_long", F.col("hi") - F.col("lo") + 1 > 30)


@query("SELECT user_id, event_type, event_id AS first_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def w05_first_wins(spark, sf_dir):
    got = windows.first_of(read(spark, sf_dir, "events"), ["user_id", "event_type"], F.col("ts"), F.col("event_id"))
    return got.select("user_id", "event_type", F.col("event_id").alias("first_id"))


@query("SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5('seed-1:' || CAST(doc_id AS VARCHAR))) <= CASE lang WHEN 'en' THEN 40 WHEN 'de' THEN 10 WHEN 'fr' THEN 10 ELSE 5 END AND lang IN ('en', 'de', 'fr', 'es')")
def w09_quota_sample(spark, sf_dir):
    return windows.quota_sample(read(spark, sf_dir, "documents"), "lang", {"en": 40, "de": 10, "fr": 10, "es": 5}, "doc_id").select("doc_id", "lang")


@query("""WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR))) - 1 AS round FROM documents)
  SELECT doc_id, source, round FROM r ORDER BY round, md5(source), source LIMIT 50""")
def w08_round_robin_sample(spark, sf_dir):
    return windows.round_robin_sample(read(spark, sf_dir, "documents"), "source", "doc_id", 50).select("doc_id", "source", F.col("round").cast("long").alias("round"))


PAIRS = "WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), d AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label < b.label WHERE list_cosine_similarity(a.v, b.v) >= 0.40)"


def similar_pairs(embeddings, floor: float):
    """a, b, cos of vectors of different labels whose cosine reaches the floor; ``a`` has the lesser label."""
    rows = embeddings.select(F.col("vec_id").alias("id"), "label", "embedding")
    return vectors.tiled_cosines(rows, rows, floor, lower=True).select("a", "b", "cos")


@query(PAIRS + " SELECT a, b FROM d")
def j05_cosine_blocking(spark, sf_dir):
    return similar_pairs(read(spark, sf_dir, "embeddings"), 0.40).select("a", "b")


@query(PAIRS + """, u AS (SELECT a, b FROM d UNION SELECT b, a FROM d), w AS (SELECT a AS node, a AS r FROM u UNION SELECT u.b, w.r FROM w JOIN u ON u.a = w.node)
  SELECT node, min(r) AS root FROM w GROUP BY node""")
def d01_d03_duplicate_clusters(spark, sf_dir):
    return graph.components(similar_pairs(read(spark, sf_dir, "embeddings"), 0.40), "a", "b")


@query(PAIRS + """, u AS (SELECT a, b FROM d UNION SELECT b, a FROM d), w AS (SELECT a AS node, a AS r FROM u UNION SELECT u.b, w.r FROM w JOIN u ON u.a = w.node), c AS (SELECT node, min(r) AS root FROM w GROUP BY node)
  SELECT e.vec_id AS node, coalesce(c.root, e.vec_id) AS root FROM e LEFT JOIN c ON c.node = e.vec_id""")
def d04_d05_components_with_singletons(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("node")).join(graph.components(similar_pairs(e, 0.40), "a", "b"), "node", "left").select("node", F.coalesce("root", "node").alias("root"))


#: All keys of orders and customers as nodes, and an edge from the lesser to the greater of each pair.
EDGES = "nodes AS (SELECT o_orderkey AS node FROM orders UNION SELECT o_custkey FROM orders), edges AS (SELECT DISTINCT least(o_orderkey, o_custkey) AS src, greatest(o_orderkey, o_custkey) AS dst FROM orders WHERE o_orderkey <> o_custkey)"


def _edges(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.least("o_orderkey", "o_custkey").alias("src"), F.greatest("o_orderkey", "o_custkey").alias("dst"))
    return o.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), o.where("src < dst").distinct()


ROLES = EDGES + ", i AS (SELECT dst AS node, count(*) AS n_in FROM edges GROUP BY 1), o AS (SELECT src AS node, count(*) AS n_out FROM edges GROUP BY 1), r AS (SELECT n.node, coalesce(n_in, 0) AS n_in, coalesce(n_out, 0) AS n_out FROM nodes n LEFT JOIN i USING (node) LEFT JOIN o USING (node)), c AS (SELECT *, CASE WHEN n_in > 0 AND n_out = 0 THEN 'thesis' WHEN n_out > 0 AND n_in = 0 THEN 'premise' WHEN n_in > 0 THEN 'sub' ELSE 'aside' END AS role FROM r)"


@query(f"WITH {ROLES} SELECT node, n_in, n_out, role FROM c")
def d07_roles(spark, sf_dir):
    return graph.roles(*_edges(spark, sf_dir))


DIST = ROLES + ", t AS (SELECT node FROM c WHERE role = 'thesis'), w AS (SELECT node, 0 AS dist FROM t UNION SELECT e.src, w.dist + 1 FROM w JOIN edges e ON e.dst = w.node WHERE w.dist < 10), b AS (SELECT node, min(dist) AS dist FROM w GROUP BY node)"


@query(f"WITH RECURSIVE {DIST} SELECT node, dist FROM b")
def d08_crux_distance(spark, sf_dir):
    nodes, edges = _edges(spark, sf_dir)
    return graph.distances(edges, graph.theses(graph.roles(nodes, edges)))


@query(f"""WITH RECURSIVE {DIST}, s AS (SELECT c.node, CASE WHEN b.dist > 0 THEN 1.0 / b.dist ELSE 0 END + CASE WHEN c.node % 7 = 0 THEN 0.5 ELSE 0 END + 0.1 * least(n_in + n_out, 5) / 5 AS raw FROM c LEFT JOIN b USING (node) WHERE c.node NOT IN (SELECT node FROM t))
  SELECT node, round(raw / max(raw) OVER (), 3) AS score FROM s QUALIFY raw > 0 AND row_number() OVER (ORDER BY round(raw, 9) DESC, node) <= 5""")
def d09_leverage(spark, sf_dir):
    return _leverage(*_edges(spark, sf_dir))


def _leverage(nodes, edges):
    classified = graph.roles(nodes, edges)
    theses = graph.theses(classified)
    rows = classified.join(theses, "node", "left_anti").join(graph.distances(edges, theses), "node", "left")
    rows = rows.withColumn("raw", graph.leverage(F.col("dist"), F.col("node") % 7 == 0, F.col("n_in") + F.col("n_out"))).where("raw > 0")
    top = rows.agg(F.max("raw").alias("most"))
    return rows.join(F.broadcast(top)).orderBy(F.round("raw", 9).desc(), "node").limit(5).select("node", F.round(F.col("raw") / F.col("most"), 3).alias("score"))


PARTS = "r AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem), n AS (SELECT s, count(*) AS n FROM r GROUP BY s), x AS (SELECT a.s AS a, b.s AS b, count(*) AS shared FROM r a JOIN r b ON a.p = b.p AND a.s < b.s GROUP BY 1, 2)"


@query(f"WITH {PARTS} SELECT a, b, shared, round(shared / least(na.n, nb.n), 6) AS share, CASE WHEN shared / least(na.n, nb.n) >= 0.5 THEN 'strong' WHEN shared / least(na.n, nb.n) >= 0.2 THEN 'weak' ELSE 'none' END AS strength FROM x JOIN n na ON na.s = a JOIN n nb ON nb.s = b")
def d15_d17_bibliographic_coupling(spark, sf_dir):
    r = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p")).distinct()
    n = r.groupBy("s").agg(F.count("*").alias("n"))
    x = r.select(F.col("s").alias("a"), "p").join(r.select(F.col("s").alias("b"), "p"), "p").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    x = x.join(n.select(F.col("s").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("s").alias("b"), F.col("n").alias("nb")), "b")
    share = F.col("shared") / F.least("na", "nb")
    return x.select("a", "b", "shared", F.round(share, 6).alias("share"), F.when(share >= 0.5, "strong").when(share >= 0.2, "weak").otherwise("none").alias("strength"))


@query("SELECT l_orderkey AS claim, count(DISTINCT l_suppkey) AS cited, count(DISTINCT s_nationkey) AS effective FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1 HAVING count(DISTINCT l_suppkey) >= 2")
def d18_effective_sources(spark, sf_dir):
    l = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("claim"), "l_suppkey").distinct()
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    return l.join(s, "l_suppkey").groupBy("claim").agg(F.count("*").alias("cited"), F.count_distinct("s_nationkey").alias("effective")).where("cited >= 2")


@query("""WITH e AS (SELECT event_id, 1 + event_id % 9 AS f, 1 + (event_id * 7) % 12 AS g, CASE event_id % 3 WHEN 0 THEN 'supports' WHEN 1 THEN 'attacks' ELSE 'supports' END AS kind, least(1, greatest(0, coalesce(value, 0.6))) AS conf FROM events)
  SELECT f AS src, g AS dst, kind, round(conf, 3) AS confidence FROM e WHERE g <= 9 AND f <> g QUALIFY row_number() OVER (PARTITION BY f, g, kind ORDER BY event_id) = 1""")
def d06_edge_validation(spark, sf_dir):
    """Numbered edges as an enrichment answers them: out of range, loops and repeats go, confidence is clamped."""
    e = read(spark, sf_dir, "events")
    kind = F.when(F.col("event_id") % 3 == 1, "attacks").otherwise("supports")
    raw = e.select("event_id", (1 + F.col("event_id") % 9).alias("src"), (1 + F.col("event_id") * 7 % 12).alias("dst"), kind.alias("kind"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("value", F.lit(0.6)))).alias("c"))
    kept = windows.first_of(raw.where("dst <= 9 and src <> dst"), ["src", "dst", "kind"], F.col("event_id"))
    return kept.select("src", "dst", "kind", F.round("c", 3).alias("confidence"))
