"""Queries of the scalar functions, predicates and segmentation (F, P, G)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..sources import links
from .registry import query, read

#: Sentences of documents, as SQL.
SENTENCES = r"""(SELECT doc_id, CAST(unnest(range(len(s))) AS INTEGER) AS j, unnest(s) AS text FROM (
  SELECT doc_id, list_filter(string_split(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS s FROM documents))"""


def sentence_rows(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode(t.sentences(F.col("text"))).alias("j", "text"))


def _sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_rows(read(spark, sf_dir, "documents"))


@query(rf"SELECT doc_id, j, text FROM {SENTENCES}")
def g03_g04_sentence_index(spark, sf_dir):
    return _sentences(spark, sf_dir)


@query(r"""SELECT doc_id, CAST(unnest(range(len(p))) AS INTEGER) AS par, unnest(p) AS text FROM (
  SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n\s*\n'), lambda x: trim(x)), lambda x: x <> '') AS p
  FROM (SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS text FROM documents WHERE doc_id % 10 = 1 UNION ALL SELECT doc_id, text FROM documents WHERE doc_id % 10 <> 1))""")
def g01_paragraphs(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    body = F.when(F.col("doc_id") % 10 == 1, F.replace("text", F.lit("\n"), F.lit("\n\n"))).otherwise(F.col("text"))
    return docs.select("doc_id", F.posexplode(t.paragraphs(body)).alias("par", "text"))


@query(r"""SELECT doc_id, md5(lower(o)) AS norm, md5(o) AS oneline, md5(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))) AS loose,
  md5(regexp_replace(lower(text), '[^a-z0-9]+', '', 'g')) AS chars, array_to_string(list_slice(string_split(o, ' '), 1, 7), ' ') AS snippet
  FROM (SELECT doc_id, text, trim(regexp_replace(text, '\s+', ' ', 'g')) AS o FROM documents)""")
def f01_f02_f03_f04_f09_normal_forms(spark, sf_dir):
    c = F.col("text")
    return read(spark, sf_dir, "documents").select(
        "doc_id", F.md5(t.norm(c)).alias("norm"), F.md5(t.oneline(c)).alias("oneline"), F.md5(t.loose(c)).alias("loose"),
        F.md5(t.charstream(t.fold_ligatures(c))).alias("chars"), t.snippet(c).alias("snippet"),
    )


@query(r"SELECT page_id, regexp_replace(regexp_replace(lower(url), '^https?://(www\.)?', ''), '/+$', '') AS url_key, regexp_replace(lower(url), '[^a-z0-9]', '', 'g') AS packed, trim(regexp_replace(lower(url), '[^a-z0-9]+', ' ', 'g')) AS spaced FROM pages")
def f07_f08_url_and_title_keys(spark, sf_dir):
    u = F.col("url")
    return read(spark, sf_dir, "pages").select("page_id", t.url_norm(u).alias("url_key"), t.charstream(u).alias("packed"), t.loose(u).alias("spaced"))


@query(rf"""WITH k AS (SELECT doc_id, j, regexp_extract_all(lower(text), '\d{{1,3}}(?:[ ,.]\d{{3}})+|\d+(?:[.,]\d+)?%?|[a-z]{{4,}}') AS raw,
  list_sort(list_filter(regexp_extract_all(lower(text), '[a-z0-9.]+'), lambda x: regexp_matches(x, '[0-9]') OR x IN ('first','second','third','fourth','fifth','zeroth','half','double','triple'))) AS keys FROM {SENTENCES})
  SELECT doc_id, j, len(raw) AS n_tokens, array_to_string(list_transform(raw, lambda x: CASE WHEN regexp_full_match(x, '\d{{1,3}}(?:[ ,.]\d{{3}})+') THEN regexp_replace(x, '[ ,.]', '', 'g') ELSE x END), '|') AS tokens, array_to_string(keys, '|') AS keys FROM k""")
def f10_f11_f12_lexical_and_key_tokens(spark, sf_dir):
    c = F.col("text")
    tokens = t.lexical_tokens(c)
    return _sentences(spark, sf_dir).select("doc_id", "j", F.size(tokens).alias("n_tokens"), F.array_join(tokens, "|").alias("tokens"), F.array_join(t.key_tokens(c), "|").alias("keys"))


@query(r"""WITH n AS (SELECT conv_id, turn, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS x FROM conversations),
  w AS (SELECT conv_id, turn, string_split(regexp_replace(x, '[,. ]+', ' ', 'g'), ' ') AS a, list_transform(string_split(x, ' '), lambda y: regexp_replace(y, '^[.,;:!?"''()]+|[.,;:!?"''()]+$', '', 'g')) AS b FROM n)
  SELECT conv_id, turn, len(list_filter(a, lambda y: y IN ('not','no','never','cannot','nor','neither','without') OR y LIKE '%n''t')) > 0 AS negated,
   len(list_filter(b, lambda y: y IN ('not','no','never','cannot','nor','neither','without') OR y LIKE '%n''t')) > 0 AS negated_stripped FROM w""")
def f13_negation(spark, sf_dir):
    c = F.col("text")
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", t.has_negation(c).alias("negated"), t.has_negation_stripped(c).alias("negated_stripped"))


@query(r"""SELECT doc_id, s AS span FROM (SELECT doc_id, unnest(list_transform(regexp_extract_all(text, '[“"]([^“”"]{10,240})[”"]', 1), lambda x: trim(x))) AS s FROM (SELECT doc_id, text || ' He said “' || replace(substr(text, 1, 60), chr(10), ' ') || '” and "' || lang || ' was"' AS text FROM documents))
  WHERE len(list_filter(string_split(trim(regexp_replace(s, '\s+', ' ', 'g')), ' '), lambda x: x <> '')) >= 3""")
def f16_quoted_spans(spark, sf_dir):
    """Each document quotes its own beginning, and two words that are too few."""
    opening = F.replace(F.substring("text", 1, 60), F.lit("\n"), F.lit(" "))
    text = F.concat("text", F.lit(" He said “"), opening, F.lit("” and \""), "lang", F.lit(" was\""))
    return read(spark, sf_dir, "documents").select("doc_id", F.explode(t.quoted_spans(text)).alias("span"))


@query(r"""SELECT page_id, regexp_replace(regexp_extract(html, '(10\.\d{4,9}/[^\s"<>]+)', 1), '[.,;)]+$', '') AS doi, regexp_extract(html, '(?i)arxiv[:/. ]\s*(?:abs/)?(\d{4}\.\d{4,5})', 1) AS arxiv,
  array_to_string(list_transform(regexp_extract_all(html || ' ' || url, 'https?://[^\s"<>]+'), lambda u: regexp_replace(u, '[.,;)]+$', '')), ' ') AS urls FROM pages""")
def f24_identifiers(spark, sf_dir):
    h = F.col("html")
    return read(spark, sf_dir, "pages").select("page_id", t.doi_in(h).alias("doi"), t.arxiv_in(h).alias("arxiv"), F.array_join(t.urls_in(F.concat_ws(" ", h, "url")), " ").alias("urls"))


@query("SELECT item_id, substr(sha1(text), 1, 8) AS id8, substr(sha1(text), 1, 12) AS id12, substr(sha1('model' || chr(31) || text), 1, 16) AS cache_key FROM benchmark")
def f27_c11_content_keys(spark, sf_dir):
    c = F.col("text")
    key = F.sha1(F.concat(F.lit("model\u001f"), c))
    return read(spark, sf_dir, "benchmark").select("item_id", F.substring(F.sha1(c), 1, 8).alias("id8"), F.substring(F.sha1(c), 1, 12).alias("id12"), F.substring(key, 1, 16).alias("cache_key"))


def garble_scores(docs: DataFrame) -> DataFrame:
    """Adds the scores of ``text``; each reads its own range: 4,000 characters, 8,000 or 20,000."""
    rows = docs.select("*", *(t.words(F.substring("text", 1, size)).alias(a) for a, size in (("a", 4000), ("b", 8000), ("c", 20000))))
    lens = F.filter(F.transform("b", lambda w: F.length(F.regexp_replace(w, "[^A-Za-z]", ""))), lambda n: n > 0)
    total = F.aggregate(lens, F.lit(0), lambda x, y: x + y)
    return rows.select(
        *docs.columns, ((F.size("a") >= 40) & (F.size(F.filter("a", lambda w: w.rlike("^[a-zA-Z]$"))) > 0.35 * F.size("a"))).alias("letter_spaced"),
        ((F.size("b") >= 40) & (F.size(lens) > 0) & (total >= 8 * F.size(lens)) & (total < 20 * F.size(lens))).alias("space_collapsed"),
        F.size(t.extract_all(F.substring("text", 1, 20000), "[A-Za-z]{25,}")).alias("glued"),
        ((F.size("c") >= 40) & (F.size(F.filter("c", lambda w: F.lower(w).rlike("^[bcdfghjklmnpqrstvwxyz]$"))) > 0.011 * F.size("c"))).alias("line_split"),
    )


@query(r"""WITH w AS (SELECT doc_id, text, string_split(trim(regexp_replace(substr(text, 1, 4000), '\s+', ' ', 'g')), ' ') AS a, string_split(trim(regexp_replace(substr(text, 1, 8000), '\s+', ' ', 'g')), ' ') AS b, string_split(trim(regexp_replace(substr(text, 1, 20000), '\s+', ' ', 'g')), ' ') AS c FROM documents),
  s AS (SELECT doc_id, text, list_filter(a, lambda x: x <> '') AS a, list_filter(b, lambda x: x <> '') AS b, list_filter(c, lambda x: x <> '') AS c FROM w),
  n AS (SELECT *, len(list_filter(a, lambda x: regexp_full_match(x, '[a-zA-Z]'))) AS singles, list_filter(list_transform(b, lambda x: len(regexp_replace(x, '[^A-Za-z]', '', 'g'))), lambda x: x > 0) AS lens, len(list_filter(c, lambda x: regexp_full_match(lower(x), '[bcdfghjklmnpqrstvwxyz]'))) AS lone FROM s)
  SELECT doc_id, len(a) >= 40 AND singles > 0.35 * len(a) AS letter_spaced, len(b) >= 40 AND len(lens) > 0 AND list_sum(lens) >= 8 * len(lens) AND list_sum(lens) < 20 * len(lens) AS space_collapsed,
   len(regexp_extract_all(substr(text, 1, 20000), '[A-Za-z]{25,}')) AS glued, len(c) >= 40 AND lone > 0.011 * len(c) AS line_split FROM n""")
def f28_garble_scores(spark, sf_dir):
    """Each score over the whole range that it is defined on."""
    return garble_scores(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


# Frequent words of the languages that the probe tells from English.
ENGLISH = "the of and to in is was that for on with as by at from it his her he she are were be this which or an not have has had their its but also they who been after when one all there would about into more other some".split()
FOREIGN = {
    "de": "der die das und ist nicht ein eine mit von für auf dem den des im sich auch als werden wurde bei aus nach über noch nur wir ihr sie es dass oder wie zum zur hat haben sind dieser diese einen einem einer durch wird kann beim sehr".split(),
    "fr": "le la les des une est dans pour que qui avec sur pas par plus mais son ses aux cette ces être sont été était ont nous vous ils elles au du et se ne je leur comme tout fait".split(),
    "es": "el los las una es en que por para con del se su sus como más pero fue son está han hay este esta estos estas también entre sobre ser lo ya sin muy cuando hasta desde".split(),
}


def _list(words):
    return ", ".join(f"'{w}'" for w in words)


@query(
    "WITH w AS (SELECT doc_id, lang, regexp_extract_all(lower(text), '[a-zA-ZÀ-ɏ]+') AS a FROM documents), c AS (SELECT doc_id, lang, len(a) AS n, "
    + ", ".join([f"len(list_filter(a, lambda x: x IN ({_list(ENGLISH)}))) AS en", *[f"len(list_filter(a, lambda x: x IN ({_list([w for w in ws if w not in ENGLISH])}))) AS {k}" for k, ws in FOREIGN.items()]])
    + " FROM w) SELECT doc_id, n, en, de, fr, es, NOT (n >= 30 AND ("
    + " OR ".join(f"({k} > en AND {k} >= greatest(10, 0.04 * n))" for k in FOREIGN)
    + ")) AS english FROM c"
)
def f29_language_probe(spark, sf_dir):
    a = F.col("a")

    def hits_of(known):
        return F.size(F.filter(a, lambda w: w.isin(known)))

    hits = {"en": hits_of(ENGLISH)} | {lang: hits_of([w for w in known if w not in ENGLISH]) for lang, known in FOREIGN.items()}
    rows = read(spark, sf_dir, "documents").select("doc_id", t.extract_all(F.lower("text"), "[a-zA-ZÀ-ɏ]+").alias("a"))
    rows = rows.select("doc_id", F.size(a).alias("n"), *[h.alias(k) for k, h in hits.items()])
    foreign = F.lit(False)
    for lang in FOREIGN:
        foreign = foreign | ((F.col(lang) > F.col("en")) & (F.col(lang) >= F.greatest(F.lit(10), 0.04 * F.col("n"))))
    return rows.withColumn("english", ~((F.col("n") >= 30) & foreign))


@query(r"""WITH w AS (SELECT doc_id, j, text, list_filter(string_split(text, ' '), lambda x: x <> '') AS a,
  list_filter(string_split(regexp_replace(text, '\.+$', ''), ' '), lambda x: x <> '') AS b FROM """ + SENTENCES + r"""),
  f AS (SELECT *, list_filter(b, lambda x: regexp_matches(x, '\p{L}')) AS alpha FROM w),
  p AS (SELECT doc_id, j, length(text) < 8 OR (len(a) < 4 AND NOT regexp_matches(text, '\d')) AS degenerate,
   len(b) BETWEEN 2 AND 7 AND len(list_filter(alpha, lambda x: regexp_matches(x, '^\p{Lu}'))) >= 2 AND len(list_filter(alpha, lambda x: NOT regexp_matches(x, '\p{Lu}') AND x NOT IN (""" + _list(t.JOURNAL_WORDS) + r"""))) = 0 AS fragment,
   regexp_matches(text, '(?i)\bdoi:\s*10\.\d{3,}|\bdoi\.org/10\.\d{3,}') OR regexp_matches(text, '\b(19|20)\d{2};\s*\d+\s*(\(\d+\))?\s*:\s*\d+') OR regexp_matches(text, '(?i)cited as follows|be cited as|recommended citation|how to cite|please cite|citation for this article|cite this (document|article|paper|work) as') AS header FROM f)
  SELECT doc_id, j, degenerate, fragment, header, degenerate OR fragment OR header AS unusable FROM p""")
def p01_p02_p03_p04_unusable_evidence(spark, sf_dir):
    c = F.col("text")
    return _sentences(spark, sf_dir).select("doc_id", "j", t.degenerate(c).alias("degenerate"), t.reference_fragment(c).alias("fragment"), t.citation_header(c).alias("header"), t.unusable(c).alias("unusable"))


@query(rf"""SELECT doc_id, j, regexp_matches(text, '{t.CONTRADICTION}') AS cue, text = '' OR regexp_matches(text, '{t.DOI}') OR regexp_matches(text, '{t.VOLUME_PAGE}') OR regexp_matches(text, '{t.EMAIL}')
  OR regexp_matches(text, '{t.BOILERPLATE}') OR regexp_matches(text, '{t.TABLE_LEAD}') OR regexp_matches(text, '{t.STAT_LEAD}') AS junk FROM {SENTENCES}""")
def p05_p06_contradiction_and_junk(spark, sf_dir):
    c = F.col("text")
    return _sentences(spark, sf_dir).select("doc_id", "j", t.contradiction_cue(c).alias("cue"), t.junk_claim(c).alias("junk"))


@query(rf"""WITH w AS (SELECT doc_id, j, text, list_filter(string_split(text, ' '), lambda x: x <> '') AS a, list_filter(string_split(regexp_replace(text, '[).\]"]+$', ''), ' '), lambda x: x <> '') AS b FROM {SENTENCES})
  SELECT doc_id, j, concat_ws(',', CASE WHEN regexp_matches(text, '^(A |The )?P\s?[<>=]') AND len(a) <= 6 THEN 'bare-stat' END,
   CASE WHEN regexp_matches(text, '(?i)\b(the intercept was|the slope was)\b') THEN 'stat-fragment' END,
   CASE WHEN regexp_matches(text, '(?i)common superscript|open symbol|closed symbol|are plotted|is plotted|line of identity|values? in the same (row|column)|shown in (the )?(figure|table)|see (figure|table)|data are presented as mean') THEN 'caption' END,
   CASE WHEN len(a) > 0 AND len(b) > 0 AND lower(b[-1]) IN ({_list(t.FUNCTION_WORDS)}) THEN 'truncated' END,
   CASE WHEN regexp_matches(text, '(?i)supported in part by|wish to express|acknowledge the|gratitude to|conflicts? of interest|disclosure questionnaire|expert peer review') THEN 'boilerplate' END,
   CASE WHEN len(a) < 4 THEN 'too-short' END) AS tags FROM w""")
def p07_p08_junk_tags(spark, sf_dir):
    return _sentences(spark, sf_dir).select("doc_id", "j", t.junk_tags(F.col("text")).alias("tags"))


LINES = "(SELECT doc_id, CAST(unnest(range(len(s))) AS INTEGER) AS k, unnest(s) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents))"


def line_rows(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "line"))


def drop_headline_runs(lines: DataFrame, least: int = 4) -> DataFrame:
    """Lines without the runs of ``least`` or more successive lines shaped like headlines (gaps and islands)."""
    flagged = lines.withColumn("head", t.headline_shaped(F.col("line")))
    order = Window.partitionBy("doc_id").orderBy("k")
    island = F.sum(F.when(F.col("head"), 0).otherwise(1)).over(order)
    run = F.count(F.when(F.col("head"), 1)).over(Window.partitionBy("doc_id", "island"))
    return flagged.withColumn("island", island).withColumn("run", run).where(~F.col("head") | (F.col("run") < least)).drop("head", "island", "run")


_STAMP_SQL = " OR ".join(f"regexp_matches(s, '{p}')" for p in t.STAMPS)


@query(rf"""WITH l AS (SELECT doc_id, k, line, trim(line) AS s, len(list_filter(string_split(trim(regexp_replace(line, '\s+', ' ', 'g')), ' '), lambda x: x <> '')) AS n FROM {LINES}),
  d AS (SELECT *, s <> '' AND ((regexp_matches(s, '^By\s+[A-Z]') AND n <= 20 AND NOT regexp_matches(s, '[.!?"”’)]$')) OR (n <= 6 AND upper(s) = s AND regexp_matches(s, '[A-Z]{{3}}') AND NOT regexp_matches(s, '\d'))
    OR (n <= 8 AND regexp_matches(s, '{t.CHROME}')) OR {_STAMP_SQL}) AS drop_it, s <> '' AND NOT regexp_matches(s, '[.!?"”’)]$') AND n BETWEEN 4 AND 30 AND regexp_matches(s, '^[\p{{Lu}}\d]') AS head FROM l),
  i AS (SELECT *, sum(CASE WHEN head THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS island FROM d WHERE NOT drop_it),
  r AS (SELECT *, count(*) FILTER (head) OVER (PARTITION BY doc_id, island) AS run FROM i)
  SELECT doc_id, k, line FROM r WHERE NOT head OR run < 4""")
def p09_g12_boilerplate_and_headline_runs(spark, sf_dir):
    lines = line_rows(read(spark, sf_dir, "documents"))
    return drop_headline_runs(lines.where(~t.boilerplate_line(F.col("line"))))


@query(rf"""WITH l AS (SELECT doc_id, line FROM {LINES} WHERE trim(line) <> ''),
  c AS (SELECT doc_id, sum(length(line)) AS chars, avg(CASE WHEN regexp_matches(line, '\(\d{{4}}[a-z]?\)\.|^[A-Z][a-z]+,\s+[A-Z]\.') THEN 1.0 ELSE 0.0 END) AS refs FROM l GROUP BY doc_id)
  SELECT d.doc_id, CAST(coalesce(c.chars, 0) AS BIGINT) AS chars, CASE WHEN regexp_matches(lower(d.text), '{t.STUB_MARKERS}') OR coalesce(c.chars, 0) < 500 OR (coalesce(c.chars, 0) < 1500 AND c.refs > 0.4) THEN 'STUB' ELSE 'OK' END AS verdict
  FROM documents d LEFT JOIN c USING (doc_id)""")
def p10_source_adequacy(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    kept = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    rows = docs.select("doc_id", "text", kept.alias("lines"))
    chars = F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + F.length(x))
    refs = F.size(F.filter("lines", lambda x: x.rlike(r"\(\d{4}[a-z]?\)\.|^[A-Z][a-z]+,\s+[A-Z]\.")))
    stub = F.lower("text").rlike(t.STUB_MARKERS) | (chars < 500) | ((chars < 1500) & (refs > 0.4 * F.size("lines")))
    return rows.select("doc_id", chars.alias("chars"), F.when(stub, "STUB").otherwise("OK").alias("verdict"))


@query(rf"""WITH s AS (SELECT doc_id, j, text FROM {SENTENCES}), f AS (SELECT *, CASE WHEN j = 0 THEN NULL ELSE lag(text) OVER (PARTITION BY doc_id ORDER BY j) END AS before FROM s),
  b AS (SELECT *, sum(CASE WHEN before IS NOT NULL AND regexp_matches(before, '{t.ABBREVIATION}') AND regexp_matches(text, '^[a-z0-9(\[]') THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY j ROWS UNBOUNDED PRECEDING) AS g FROM f)
  SELECT doc_id, CAST(g - 1 AS INTEGER) AS j, string_agg(text, ' ' ORDER BY b.j) AS text FROM b GROUP BY doc_id, g""")
def g05_abbreviation_merge(spark, sf_dir):
    order = Window.partitionBy("doc_id").orderBy("j")
    ending = F.right("text", F.lit(12))  # no abbreviation is longer, with the character before it
    glued = (F.col("j") > 0) & F.lag(ending).over(order).rlike(t.as_re2(t.ABBREVIATION)) & F.col("text").rlike(r"^[a-z0-9(\[]")
    rows = _sentences(spark, sf_dir).withColumn("starts", F.when(glued, 0).otherwise(1))
    rows = rows.withColumn("g", F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = rows.groupBy("doc_id", "g").agg(F.array_sort(F.collect_list(F.struct("j", "text"))).alias("parts"))
    return merged.select("doc_id", (F.col("g") - 1).cast("int").alias("j"), F.array_join("parts.text", " ").alias("text"))


@query(r"""WITH s AS (SELECT item_id, list_filter(string_split(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS a FROM benchmark)
  SELECT item_id, k, item_id || '#tail' || k AS tail_id, array_to_string(list_slice(a, len(a) - k + 1, len(a)), ' ') AS text FROM (SELECT *, CAST(unnest([1, 2]) AS INTEGER) AS k FROM s) WHERE k < len(a)""")
def g11_tail_suffixes(spark, sf_dir):
    """Proper suffixes of one and two sentences of every claim."""
    rows = read(spark, sf_dir, "benchmark").select("item_id", t.sentences(F.col("text")).alias("a"))
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(2)))).where(F.col("k") < F.size("a"))
    return rows.select("item_id", "k", F.concat("item_id", F.lit("#tail"), "k").alias("tail_id"), F.array_join(F.slice("a", -F.col("k"), F.col("k")), " ").alias("text"))


#: Claims with citation markers, made from documents: every second sentence carries one.
MARKED = rf"""(SELECT doc_id, string_agg(CASE WHEN j % 2 = 1 THEN text || ' [[src' || (doc_id % 7) || ']]' ELSE text END, ' ' ORDER BY j) AS body FROM {SENTENCES} GROUP BY doc_id)"""


def marked_texts(spark, sf_dir):
    rows = _sentences(spark, sf_dir)
    piece = F.when(F.col("j") % 2 == 1, F.concat("text", F.lit(" [[src"), F.col("doc_id") % 7, F.lit("]]"))).otherwise(F.col("text"))
    parts = rows.withColumn("piece", piece).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("j", "piece"))).alias("p"))
    return parts.select("doc_id", F.array_join("p.piece", " ").alias("body"))


def split_claims(texts: DataFrame, key: str = "doc_id") -> DataFrame:
    """Claims of a marked text: (key, claim, text, markers). Text up to a group of markers is a claim; the markers of a
    part without content go to the claim before it in the paragraph, or are lost if there is none."""
    group = r"((?:\[\[[^\[\]]+\]\][\s;,]*)+)"
    pieces = F.split(F.regexp_replace("par", group, f"{t.MARK}$1{t.MARK}"), t.MARK)
    rows = texts.select(key, F.posexplode(t.paragraphs(F.col("body"))).alias("p", "par"))
    rows = rows.select(key, "p", F.posexplode(pieces).alias("i", "piece"))
    is_group = F.col("piece").rlike(r"^\[\[")
    text = F.regexp_replace(t.oneline(F.col("piece")), r"^[\s.,;:!?)\]]+", "")
    rows = rows.select(key, "p", "i", is_group.alias("grp"), F.when(~is_group, text).alias("text"), F.when(is_group, t.extract_all(F.col("piece"), r"\[\[([^\[\]]+)\]\]", 1)).alias("keys"))
    starts = F.when(~F.col("grp") & F.col("text").rlike(r"[\p{L}\p{N}]"), 1).otherwise(0)
    rows = rows.withColumn("starts", starts).withColumn("n", F.sum("starts").over(Window.partitionBy(key, "p").orderBy("i")))
    claims = rows.where("n > 0").groupBy(key, "p", "n").agg(F.max(F.when(F.col("starts") == 1, F.col("text"))).alias("text"), F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col("grp"), F.struct("i", "keys")))), lambda x: x["keys"]))).alias("markers"))
    number = F.row_number().over(Window.partitionBy(key).orderBy("p", "n")) - 1
    return claims.select(key, number.alias("claim"), "text", "markers")


@query(rf"""WITH b AS (SELECT doc_id, string_split(regexp_replace(body, '((?:\[\[[^\[\]]+\]\][\s;,]*)+)', chr(1) || '\1' || chr(1), 'g'), chr(1)) AS a FROM {MARKED}),
  r AS (SELECT doc_id, unnest(range(len(a))) AS i, unnest(a) AS piece FROM b),
  f AS (SELECT *, piece LIKE '[[%' AS grp, regexp_replace(trim(regexp_replace(piece, '\s+', ' ', 'g')), '^[\s.,;:!?)\]]+', '') AS txt FROM r),
  n AS (SELECT *, sum(CASE WHEN NOT grp AND regexp_matches(txt, '[\p{{L}}\p{{N}}]') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS n, NOT grp AND regexp_matches(txt, '[\p{{L}}\p{{N}}]') AS starts FROM f)
  SELECT doc_id, CAST(n - 1 AS INTEGER) AS claim, max(txt) FILTER (starts) AS text, coalesce(max(regexp_extract(piece, '\[\[([^\[\]]+)\]\]', 1)) FILTER (grp), '') AS markers FROM n WHERE n > 0 GROUP BY doc_id, n""")
def g02_claims_by_marker(spark, sf_dir):
    return split_claims(marked_texts(spark, sf_dir)).select("doc_id", "claim", "text", F.array_join("markers", ",").alias("markers"))


@query(rf"""WITH w AS (SELECT *, regexp_extract(text, '\d+(?:[.,]\d+)?') AS raw FROM (SELECT 'The value rose to ' || CAST(doc_id AS VARCHAR) || ' units in ' || source AS text, doc_id FROM documents UNION ALL SELECT 'More people agree in ' || lang, -doc_id - 1 FROM documents))
  SELECT doc_id, CASE WHEN raw = '0' THEN replace(text, 'rose', 'fell') WHEN raw <> '' THEN replace(text, ' ' || raw || ' ', ' ' || CAST(CAST(floor(CAST(raw AS DOUBLE) * 3.7) AS BIGINT) AS VARCHAR) || ' ') ELSE replace(text, 'More', 'less') END AS corrupted FROM w""")
def f30_error_injection(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    a = docs.select("doc_id", F.concat(F.lit("The value rose to "), "doc_id", F.lit(" units in "), "source").alias("text"))
    b = docs.select((-F.col("doc_id") - 1).alias("doc_id"), F.concat(F.lit("More people agree in "), "lang").alias("text"))
    return a.unionByName(b).select("doc_id", F.coalesce(t.inject_error(F.col("text")), "text").alias("corrupted"))


@query(r"""WITH p AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_replace(lower(substr(html, 1, 12000)), '[^a-z0-9 ]', ' ', 'g') AS o FROM pages),
  s AS (SELECT *, list_filter(string_split(regexp_replace(lower(title), '[^a-z0-9 ]', ' ', 'g'), ' '), lambda x: length(x) > 3) AS sig, list_filter(string_split(o, ' '), lambda x: x <> '') AS toks, replace(o, ' ', '') AS compact FROM p)
  SELECT page_id, CASE WHEN len(sig) < 3 THEN 'unknown' WHEN len(list_filter(sig, lambda x: list_contains(toks, x) OR contains(compact, x))) >= 0.6 * len(sig) THEN 'ok' ELSE 'mismatch' END AS status FROM s""")
def f32_title_check(spark, sf_dir):
    pages = read(spark, sf_dir, "pages")
    return pages.select("page_id", t.title_check(F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.col("html")).alias("status"))


@query(r"""WITH p AS (SELECT page_id, regexp_extract(url, '^https?://[^/]+') AS site FROM pages), l AS (SELECT page_id, site, unnest(CASE WHEN page_id % 2 = 0 THEN ['/m.pdf', '/a.PDF?v=1', '/b.pdf'] ELSE ['/a.PDF?v=1', '/b.pdf', '/m.pdf', '/c.pdf#p'] END) AS link, unnest(CASE WHEN page_id % 2 = 0 THEN [0, 1, 2] ELSE [0, 1, 2, 3] END) AS pos FROM p)
  SELECT page_id, pos, site || link AS link FROM l""")
def c07_link_extraction(spark, sf_dir):
    """Every second page names its PDF in a meta tag; all have PDF links, written in several ways, besides their own links."""
    anchors = """<a href="/x">x</a><a class="k" href='/a.PDF?v=1'>a</a><a href="/a.PDF?v=1">a</a><A HREF=/b.pdf>b</A><a href="/m.pdf">m</a>"""
    more = F.when(F.col("page_id") % 2 == 0, '<meta content="/m.pdf" name="citation_pdf_url">').otherwise('<a href="mailto:a.pdf">y</a><a href="/c.pdf#p">c</a><a href="/d.pdf">d</a>')
    pages = read(spark, sf_dir, "pages")
    return links.extract_pdf_links(pages.select("page_id", "url", F.concat(F.lit(anchors), more, F.col("html")).alias("html")))


# Hosts of papers, and beginnings of words of the domains that a benchmark leaves out.
PAPER_HOSTS = r"nber\.org|ssrn\.com|openreview\.net|biorxiv\.org|osf\.io|semanticscholar\.org|ncbi\.nlm\.nih\.gov|pubmed\."
BLOCKED_DOMAINS = (
    r"(?i)\b(cancer|tumou?r|disease|diagnos|medic|clinic|hospital|patient|drug|pharma|vaccin|virus|viral|bacteri|infect|epidemi|pandemi|surg|therap|"
    r"psychiatr|symptom|syndrome|obesit|diabet|cardio|neuro|genom|gene\b|genetic|dna|rna|protein|enzyme|organism|species|biolog|botan|ecolog|"
    r"physiolog|anatom|chemical|chemist|compound|toxi|poison|molecul|nuclear|radioactiv|explos|weapon|firearm|ammunit|malware|hack|"
    r"cybersec|encrypt|exploit\b|vulnerabilit|suicid|overdose|abortion|pregnan|autops|forensic)\w*"
)


@query(rf"""SELECT page_id, CASE WHEN regexp_matches(lower(url), '\.pdf$') OR regexp_matches(lower(url), '{PAPER_HOSTS}') THEN 'paper' ELSE 'web' END AS kind,
  regexp_matches(html || CASE WHEN page_id % 3 = 0 THEN ' Genomes and toxins' ELSE '' END, '{BLOCKED_DOMAINS}') AS blocked FROM pages""")
def p21_p22_page_classes(spark, sf_dir):
    u = F.lower("url")
    paper = u.rlike(r"\.pdf$") | u.rlike(PAPER_HOSTS)
    body = F.concat("html", F.when(F.col("page_id") % 3 == 0, " Genomes and toxins").otherwise(""))
    return read(spark, sf_dir, "pages").select("page_id", F.when(paper, "paper").otherwise("web").alias("kind"), body.rlike(BLOCKED_DOMAINS).alias("blocked"))
