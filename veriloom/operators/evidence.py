"""Gates and locations of evidence: pages, fragments of the claim's own wording, entities, dates, bylines."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as t

# Months as they are written, how a negative answer names what is missing, and where such a part ends.
MONTHS = {m: k for k, ms in enumerate(["jan january", "feb february", "mar march", "apr april", "may", "jun june", "jul july", "aug august", "sep sept september", "oct october", "nov november", "dec december"], 1) for m in ms.split()}
MISSING_PART = [
    r"(?i)(?:passage|sources?|text|claim)s?\s+do(?:es)?\s+not\s+(?:explicitly\s+)?(?:state|mention|contain|include|say|support|back|establish|demonstrate|show|confirm|indicate|prove|note|report|specify|address|discuss|provide|make)\s*(?:that\s+|the\s+claim\s+that\s+|information\s+about\s+|any\s+)?(.+)",
    r"(?i)the\s+(?:claim|fact|statement)\s+that\s+(.+?)\s+is\s+not\s+(?:explicitly\s+|unambiguously\s+)?(?:stated|mentioned|supported|entailed|present|contained)",
    r"(?i)the\s+(?:claim|fact|statement|assertion)\s+that\s+(.+?)\s+is\s+(?:directly\s+|explicitly\s+)?contradicted",
    r"(?i)(?:passage|sources?|text)s?\s+(?:directly\s+|explicitly\s+)?contradicts?\s+(?:the\s+(?:claim|statement|assertion|fact|idea)\s+(?:that\s+)?|that\s+)?(.+)",
]
PART_BREAK = r"(?i),?\s+(?:nor|or|and)\s+that\s+|,?\s+nor\s+"
PART_TAIL = r"(?i)\s+[—–;]\s+.*$|,\s+(?:because|since|whereas|which|as\s+the\s+passage)\b.*$"
PRONOUNS = ["it", "this", "that", "them", "the claim", "the statement", "the assertion", "the fact"]


@F.pandas_udf(T.StringType())
def fold(texts: pd.Series) -> pd.Series:
    """Lower case without combining marks."""
    return texts.map(lambda s: None if s is None else "".join(c for c in unicodedata.normalize("NFKD", s.lower()) if not unicodedata.combining(c)))


@F.pandas_udf(T.StringType())
def unify(texts: pd.Series) -> pd.Series:
    """Compatibility form, straight quotes and plain dashes, case folded."""
    table = str.maketrans({"“": '"', "”": '"', "‘": "'", "’": "'", "–": "-", "—": "-", "−": "-"})
    return texts.map(lambda s: None if s is None else " ".join(unicodedata.normalize("NFKC", s).translate(table).casefold().split()))


def word_grams(c: Column, n: int = 6) -> Column:
    """All runs of n words of the loose form, none if there are fewer words."""
    a = F.split(t.loose(c), " ")
    return F.when(F.size(a) >= n, F.transform(F.sequence(F.lit(1), F.size(a) - n + 1), lambda k: F.array_join(F.slice(a, k, n), " "))).otherwise(F.array().cast("array<string>"))


def unsourced_fragment(extracted: Column, claim: Column, source: Column, n: int = 6) -> Column:
    """Does the extraction hold n words of the claim's own wording that the source does not hold?"""
    shared = F.array_intersect(word_grams(extracted, n), word_grams(claim, n))
    padded = F.concat(F.lit(" "), t.loose(source), F.lit(" "))
    once = F.array(F.struct(shared.alias("grams"), padded.alias("padded"), t.charstream(source).alias("stream")))  # computed once a row

    def missing(r: Column, g: Column) -> Column:
        return ~F.contains(r["padded"], F.concat(F.lit(" "), g, F.lit(" "))) & ~F.contains(r["stream"], F.replace(g, F.lit(" "), F.lit("")))

    return F.exists(once, lambda r: F.exists(r["grams"], lambda g: missing(r, g)))


def page_of(sentences: DataFrame, pages: DataFrame, key: str) -> DataFrame:
    """(key, j, page): the first page that holds the whole sentence, else the first that holds its first six words."""
    s = sentences.select(key, "j", t.norm(F.col("text")).alias("s"))
    p = pages.select(key, "page", t.norm(F.col("page_text")).alias("p"))
    prefix = F.array_join(F.slice(F.split("s", " "), 1, 6), " ")
    rank = F.when(F.contains(F.col("p"), F.col("s")), 0).when(F.contains(F.col("p"), prefix), 1)
    hit = s.join(p, key).select(key, "j", rank.alias("rank"), "page").where("rank is not null")
    return hit.groupBy(key, "j").agg(F.min(F.struct("rank", "page")).alias("m")).select(key, "j", F.col("m.page").alias("page"))


def missing_parts(reason: Column) -> Column:
    """What a negative answer says is absent: up to three parts, pronouns left out."""
    first = F.coalesce(*[F.nullif(F.regexp_extract(reason, p, 1), F.lit("")) for p in MISSING_PART])
    parts = F.split(F.regexp_replace(first, PART_BREAK, t.MARK), t.MARK)
    clean = F.transform(parts, lambda p: F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(p, PART_TAIL, "")), "^[\"“”'‘’]+|[\"“”'‘’]+$", ""), r"\.+$", ""))
    return F.coalesce(F.slice(F.filter(clean, lambda p: (p != "") & ~F.lower(p).isin(PRONOUNS)), 1, 3), F.array().cast("array<string>"))


def figure_present(figure: Column, text: Column) -> Column:
    """A figure in its own form: grouped thousands, percent, decimal, or digits with no digit beside them."""
    escaped = F.regexp_replace(figure, r"([.+*?^${}()|\[\]\\])", r"\\$1")
    pattern = (
        F.when(figure.rlike(r"^\d{1,3}(,\d{3})+$"), F.regexp_replace(figure, ",", "[,\\\\s  ]?"))
        .when(figure.rlike(r"^\d+%$"), F.concat(F.regexp_replace(figure, "%", ""), F.lit(r"\s*%")))
        .when(figure.rlike(r"^\d+\.\d+$"), F.regexp_replace(figure, r"\.", "[.·]"))
        .otherwise(F.concat(F.lit(r"(^|\D)"), escaped, F.lit(r"(\D|$)")))
    )
    return F.regexp_like(text, pattern)


def written_date(line: Column) -> Column:
    """YYYY-MM-DD of the first date of a line; day and month are only checked for range. Null if there is none."""
    months = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])
    name = r"([A-Za-z]{3,9})\.?"

    def made(y: Column, m: Column, d: Column) -> Column:
        y, m, d = (c.try_cast("int") for c in (y, m.cast("string"), d))
        return F.when(m.between(1, 12) & d.between(1, 31), F.format_string("%04d-%02d-%02d", y, m, d))

    iso, us, eu = r"\b((?:19|20)\d{2})-(\d{2})-(\d{2})\b", rf"\b{name} (\d{{1,2}}),? ((?:19|20)\d{{2}})\b", rf"\b(\d{{1,2}}) {name} ((?:19|20)\d{{2}})\b"
    get = lambda p, g: F.regexp_extract(line, p, g)
    return F.coalesce(made(get(iso, 1), get(iso, 2), get(iso, 3)), made(get(us, 3), F.try_element_at(months, F.lower(get(us, 1))), get(us, 2)), made(get(eu, 3), F.try_element_at(months, F.lower(get(eu, 2))), get(eu, 1)))


def author_byline(sentences: DataFrame, key: str) -> DataFrame:
    """(key, author) of the first explicit author line, of one to four words."""
    name = F.trim(F.regexp_extract("text", r"(?i)^\s*author:\s*([^\n;|]{2,60})", 1))
    rows = sentences.withColumn("author", name).where((F.col("author") != "") & F.size(t.words(F.col("author"))).between(1, 4))
    return rows.groupBy(key).agg(F.min_by("author", "j").alias("author"))


def source_label(title: Column, author: Column, date: Column) -> Column:
    note = F.concat_ws("; ", F.when(author.isNotNull(), F.concat(F.lit("byline: "), author)), F.when(date.isNotNull(), F.concat(F.lit("article dated "), date)))
    return F.when(note != "", F.concat(title, F.lit(" ("), note, F.lit(")"))).otherwise(title)


def names_source(claim: Column, key: Column) -> Column:
    surname = F.lower(F.regexp_extract(key, "^([A-Za-z]+)", 1))
    return (F.length(surname) >= 4) & F.contains(F.lower(claim), surname)


def entities_named(entities: Column, text: Column) -> Column:
    """Does the text hold at least one token of every entity?"""
    return F.forall(entities, lambda e: F.exists(F.split(e, " "), lambda w: F.contains(text, w)))


def same_title(a: Column, b: Column) -> Column:
    x, y = t.charstream(a), t.charstream(b)
    return (x == y) | ((F.least(F.length(x), F.length(y)) >= 20) & (F.contains(x, y) | F.contains(y, x)))


def merge_bibliography(new: DataFrame, known: DataFrame) -> DataFrame:
    """Each new entry with the known one it is: by DOI, else URL, else title; null if it is new."""
    keys = {"doi": F.lower("doi"), "url": t.url_norm(F.col("url")), "title": t.charstream(F.col("title"))}
    out = new
    for name, key in keys.items():
        side = known.select(key.alias(f"__{name}"), F.col("key").alias(f"__by_{name}")).where(F.col(f"__{name}") != "")
        side = side.groupBy(f"__{name}").agg(F.min(f"__by_{name}").alias(f"__by_{name}"))
        out = out.withColumn(f"__{name}", key).join(side, f"__{name}", "left").drop(f"__{name}")
    return out.withColumn("same_as", F.coalesce(*[f"__by_{n}" for n in keys])).drop(*[f"__by_{n}" for n in keys])


def tiered_match(candidates: DataFrame, key: str, value: str) -> DataFrame:
    """The first tier with a candidate decides; more than one in it blocks the match."""
    rows = candidates.select(key, value, "tier").distinct().withColumn("best", F.min("tier").over(Window.partitionBy(key)))
    found = rows.where("tier = best").groupBy(key).agg(F.count("*").alias("n"), F.min(value).alias(value), F.min("tier").alias("tier"))
    return found.select(key, F.when(F.col("n") == 1, F.col(value)).alias(value), "tier", F.when(F.col("n") == 1, "matched").otherwise("ambiguous").alias("status"))


def snowball(papers: DataFrame, cites: DataFrame, seeds: DataFrame, depth: int = 2, branching: int = 5) -> DataFrame:
    """(paper, level, found_via): from the seeds, the best ``branching`` unseen neighbours of each node, level by level.

    ``papers`` has (paper, relevance), ``cites`` (src, dst). Bounded by depth and branching, whatever the graph.
    """
    from .lineage import cut

    seen = cut(seeds.select("paper", F.lit(0).alias("level"), F.array(F.col("paper")).alias("found_via")))
    frontier = seen
    for level in range(1, depth + 1):
        near = frontier.join(cites.withColumnRenamed("src", "paper"), "paper").join(papers.select(F.col("paper").alias("dst"), "relevance"), "dst")
        fresh = near.join(seen.select(F.col("paper").alias("dst")), "dst", "left_anti")
        rank = F.row_number().over(Window.partitionBy("paper").orderBy(F.col("relevance").desc(), "dst"))
        best = fresh.withColumn("n", rank).where(F.col("n") <= branching)
        first = best.groupBy("dst").agg(F.min_by("found_via", F.struct("n", "paper")).alias("via"))
        frontier = cut(first.select(F.col("dst").alias("paper"), F.lit(level).alias("level"), F.array_append("via", F.col("dst")).alias("found_via")))
        seen = seen.unionByName(frontier)
    return seen
