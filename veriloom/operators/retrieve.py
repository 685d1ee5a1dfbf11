"""Relevance of texts for claims: cosine, lexical weight, fusion of rankings, cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t

RRF_K = 5


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision; 0 where a norm is 0."""

    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)

    dot = total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    norm = F.sqrt(total(F.transform(a, lambda x: x.cast("double") * x.cast("double")))) * F.sqrt(total(F.transform(b, lambda x: x.cast("double") * x.cast("double"))))
    return F.when(norm > 0, dot / norm).otherwise(0.0)


def rank(by: list[str], *order: Column) -> Column:
    """Position from 0 in a stable order: the ties must be broken by ``order`` itself."""
    return F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1


def lexical_scores(claims: DataFrame, texts: DataFrame, source: str, claim: str, position: str) -> DataFrame:
    """claim, source, position, lex: weight of the claim's tokens in each text of a source.

    A token weighs ln(1 + n / (1 + df)) with n texts and df of them holding it, both within the source and claim.
    ``claims`` has (claim, claim_text, source); ``texts`` has (source, position, text).
    """
    tokens = claims.select(claim, source, F.explode(F.array_distinct(t.lexical_tokens(F.col("claim_text")))).alias("tok"))
    held = texts.select(source, position, F.explode(F.array_distinct(t.lexical_tokens(F.col("text")))).alias("tok"))
    hits = tokens.join(held, [source, "tok"])
    df = hits.groupBy(claim, source, "tok").agg(F.count("*").alias("df"))
    n = texts.groupBy(source).agg(F.count("*").alias("n"))
    weight = F.log(1 + F.col("n") / (1 + F.col("df")))
    scored = hits.join(df, [claim, source, "tok"]).join(n, source).groupBy(claim, source, position).agg(F.sum(weight).alias("lex"))
    every = claims.select(claim, source).distinct().join(texts.select(source, position), source)
    return every.join(scored, [claim, source, position], "left").select(claim, source, position, F.coalesce("lex", F.lit(0.0)).alias("lex"))


def fuse(scored: DataFrame, by: list[str], position: str, cos: str = "cos", lex: str = "lex") -> DataFrame:
    """Adds ``rrf``, the reciprocal-rank fusion of two scores."""
    rc, rl = rank(by, F.col(cos).desc(), F.col(position)), rank(by, F.col(lex).desc(), F.col(position))
    return scored.withColumn("rc", rc).withColumn("rl", rl).withColumn("rrf", 1.0 / (RRF_K + F.col("rc")) + 1.0 / (RRF_K + F.col("rl"))).drop("rc", "rl")


def top_with_floor(scored: DataFrame, by: list[str], score: str, position: str, k: int = 3, floor: float = 0.55) -> DataFrame:
    """The k best of each group, and only then those that reach the floor."""
    return scored.withColumn("rank", rank(by, F.col(score).desc(), F.col(position))).where((F.col("rank") < k) & (F.col(score) >= floor))


def link_evidence(scored: DataFrame, by: list[str], score: str, position: str, least: float = 0.75, most: int = 3) -> DataFrame:
    """Up to ``most`` sentences over the bar, or else the best one."""
    order = Window.partitionBy(*by).orderBy(F.col(score).desc(), F.col(position))
    rows = scored.withColumn("rn", F.row_number().over(order)).withColumn("best", F.max(score).over(Window.partitionBy(*by)))
    return rows.where(((F.col(score) >= least) & (F.col("rn") <= most)) | ((F.col("rn") == 1) & (F.col("best") < least))).drop("rn", "best")


def gate_chunks(chunks: DataFrame, by: list[str], n_sentences: str, top: int = 6) -> DataFrame:
    """With more than ``top`` chunks: the best by cosine and a few by lexical weight that is not zero."""
    size = F.count("*").over(Window.partitionBy(*by))
    extra = F.greatest(F.lit(2), F.least(F.lit(8), F.floor(F.col(n_sentences) / 40)))
    rows = chunks.withColumn("size", size).withColumn("rc", rank(by, F.col("cos").desc(), F.col("chunk"))).withColumn("rl", rank(by, F.col("lex").desc(), F.col("chunk")))
    return rows.where((F.col("size") <= top) | (F.col("rc") < top) | ((F.col("rl") < extra) & (F.col("lex") > 0))).drop("size", "rc", "rl")


def map_to_sentence(quotes: DataFrame, sentences: DataFrame, source: str, least: float = 0.6) -> DataFrame:
    """quote, source, j: the sentence that a quoted text stands for; equal, contained, or by overlap of words."""
    # words are counted before the join, so that most pairs are told apart by two numbers and two searches
    distinct = lambda c: F.array_distinct(F.split(c, " "))
    left = quotes.select("quote", source, t.norm(F.col("quote_text")).alias("a")).withColumn("na", F.size(distinct("a")))
    right = sentences.select(source, "j", t.norm(F.col("text")).alias("b")).where("b <> ''").withColumn("nb", F.size(distinct("b")))
    pairs = left.join(right, source)
    short, long = F.least(F.length("a"), F.length("b")), F.greatest(F.length("a"), F.length("b"))
    held = (short >= 20) & (F.contains(F.col("a"), F.col("b")) | F.contains(F.col("b"), F.col("a")))
    sized = F.least("na", "nb") >= least * F.greatest("na", "nb") - 1e-9
    pairs = pairs.where(sized | held | (F.col("a") == F.col("b")))
    wa, wb = distinct("a"), distinct("b")
    score = F.when(F.col("a") == F.col("b"), 2.0).when(held, 0.6 + 0.4 * short / long).otherwise(F.size(F.array_intersect(wa, wb)) / F.size(F.array_union(wa, wb)))
    best = pairs.withColumn("score", score).groupBy("quote", source).agg(F.max(F.struct("score", (-F.col("j")).alias("first"))).alias("m"))
    return best.where(F.col("m.score") >= least).select("quote", source, (-F.col("m.first")).alias("j"), F.col("m.score").alias("score"))
