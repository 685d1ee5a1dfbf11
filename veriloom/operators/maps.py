"""Argument maps and their upkeep: variants of claims, confirmed independence, replacement proposals, reading sections."""

from __future__ import annotations

from collections.abc import Callable
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as t
from . import graph, retrieve, sequential
from .lineage import cut

# What makes two claims variants, and how much of a source an arbiter reads.
LEX_STRONG, LEX_WEAK, COS_WEAK = 0.90, 0.75, 0.93
WHOLE_WORDS, SECTION_WORDS = 30_000, 20_000
TILE, SLICE = 1024, 256  # claims of a block, rows of a tile that are compared at once
KNOWN = 1 << 14  # ratios of texts that a task keeps


def variant_pairs(claims: DataFrame, by: str) -> DataFrame:
    """by, a, b, strength, lex, cos of pairs of one map's claims (by, ord, text, vector) that may be the same.

    Nearly equal wording is strong unless only one of them negates; somewhat equal wording, or vectors that lie close,
    are weak. A map's claims are compared with each other only; the earlier one is ``a``. ``vector`` may be null.
    Claims of equal wording are paired without a comparison. Those of a map of more than ``TILE`` claims are dealt into
    blocks, each two of which are a task's tile for the others: cosines are a matrix product there, and wordings are
    compared once for each two texts.
    """
    rows = claims.where(F.col(by).isNotNull() & F.col("ord").isNotNull())
    floats = claims.schema["vector"].dataType.simpleString() in ("array<float>", "array<double>")
    vector = F.col("vector") if floats else F.col("vector").cast("array<double>").alias("vector")
    rows = rows.select(by, "ord", t.norm(F.col("text")).alias("text"), t.has_negation(F.col("text")).alias("negated"), vector)
    dealt = _dealt(rows, by).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiled = dealt.select(by, F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "ord", "text", "negated", "vector")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    found = tiled.groupBy(by, "low", "high").applyInArrow(_variant_tile(by, copies=False), f"`{by}` {kinds[by]}, a {kinds['ord']}, b {kinds['ord']}, strength string, lex double, cos double")
    found = found.unionByName(_copies(rows, by))
    return found.withColumn("lex", F.round("lex", 3)).withColumn("cos", F.round("cos", 3))


def _dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows with the blocks of their group, of about ``TILE`` rows at most, and the one they are dealt into."""
    large = rows.groupBy(*keys).agg(F.ceil(F.count("*") / F.lit(TILE)).cast("int").alias("blocks")).where("blocks > 1")
    dealt = rows.join(F.broadcast(large), list(keys), "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    return dealt.withColumn("block", F.pmod(F.xxhash64("ord"), F.col("blocks")).cast("int"))


def _copies(rows: DataFrame, by: str) -> DataFrame:
    """The pairs of equal wording, all of which are strong, as equal wording negates alike.

    The claims of a text are gathered by blocks, and each two blocks are a unit of work. Vectors stand apart from the
    places, so that neither they nor cosines are there where nobody reads ``cos``.
    """
    kept = _dealt(rows.where("text is not null"), by, "text")
    finite = F.when(F.exists("vector", lambda v: F.isnan(v - v)), None).otherwise(F.col("vector"))  # others have no cosine
    gathered = kept.groupBy(by, "text", "block").agg(F.max("blocks").alias("blocks"), F.collect_list("ord").alias("ords"), F.collect_list(F.struct(finite.alias("vector"))).alias("vectors")).where("blocks > 1 or size(ords) > 1")
    low, high = (gathered.select(by, "text", F.col("block").alias(block), F.col("ords").alias(f"{block}_ords"), F.col("vectors").alias(f"{block}_vectors")) for block in ("low", "high"))
    # a stated number, as units are few bytes and many rows, and would be put into few tasks by their bytes
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    units = low.join(high, [by, "text"]).where("low <= high").repartition(tasks, by, "text", "low", "high")
    first = units.select("*", F.posexplode("low_ords").alias("i", "x"))
    pairs = first.select("*", F.posexplode("high_ords").alias("j", "y")).where("x <> y and (low <> high or x < y)")
    x, y = F.col("low_vectors")[F.col("i")]["vector"], F.col("high_vectors")[F.col("j")]["vector"]
    cos = F.when(x.isNotNull() & y.isNotNull(), F.nanvl(retrieve.cosine(x, y), F.lit(None).cast("double")))
    return pairs.select(by, F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.lit("strong").alias("strength"), F.lit(1.0).alias("lex"), cos.alias("cos"))


def _cosines(vectors: pa.Array) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Cosines of some vectors with others: 0 where a norm is 0 or an element null, nan where one is null or their lengths differ."""
    size = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    width, mixed = max(1, size.max()), size.min() < size.max()
    row, column = np.nonzero(np.arange(width) < size[:, None])
    flat, unit = pc.list_flatten(vectors), np.zeros((len(size), width))
    unit[row, column] = flat.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
    if flat.null_count:
        unit[row[flat.is_null().to_numpy(zero_copy_only=False)]] = 0.0
    norms = np.sqrt((unit * unit).sum(1, keepdims=True))
    unit /= np.where(norms > 0, norms, 1.0)
    zero = norms[:, 0] == 0

    def some(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        cos = unit[x] @ unit[y].T
        if mixed:
            cos[(size[x, None] != size[None, y]) & ~zero[x, None] & ~zero[None, y]] = np.nan
        cos[size[x] < 0] = np.nan
        cos[:, size[y] < 0] = np.nan
        return cos

    return some


def _likely(words: list[str], asked: np.ndarray) -> np.ndarray:
    """Those of the asked pairs of texts whose lengths and letters do not keep their ratio below ``LEX_WEAK``."""
    length = np.array([len(w) for w in words], np.int64)
    letters = np.zeros((len(words), 64), np.int64)  # a few letters share a place, which only lets more pairs through
    for k, w in enumerate(words):
        np.add.at(letters[k], np.frombuffer(w.encode("utf-32-le", "surrogatepass"), np.uint32) % 64, 1)
    out = np.zeros_like(asked)
    for lo in range(0, len(words), SLICE):
        part = slice(lo, lo + SLICE)
        least = LEX_WEAK * (length[part, None] + length[None, :])
        out[part] = asked[part] & (2 * np.minimum(length[part, None], length[None, :]) >= least)
        if out[part].any():
            out[part] &= 2 * sum(np.minimum(letters[part, None, k], letters[None, :, k]) for k in range(64)) >= least
    return out


def _variant_tile(by: str, copies: bool = True):
    """A function of a tile's claims that gives their pairs, those of equal wording if ``copies``."""
    known = {}  # ratios of earlier tiles, whose texts may recur

    def ratio(a: str, b: str) -> float:
        if (a, b) not in known:
            if len(known) >= KNOWN:
                known.clear()
            known[a, b] = SequenceMatcher(None, a, b).ratio()
        return known[a, b]

    def tile(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ords, block = table.column("ord"), table.column("block").to_numpy()
        rank = np.unique(ords.to_numpy(), return_inverse=True)[1]
        rows = np.argsort(rank, kind="stable")
        crossed = table.column("low")[0].as_py() != table.column("high")[0].as_py()
        sides = [rows[block[rows] == table.column(side)[0].as_py()] for side in ("low", "high")]
        texts = table.column("text").combine_chunks().dictionary_encode()
        words, code = texts.dictionary.to_pylist(), texts.indices.fill_null(-1).to_numpy()
        negated = table.column("negated").fill_null(False).to_numpy()
        cosines = _cosines(table.column("vector").combine_chunks())

        # texts of which some claim comes before one of the other's
        earliest, latest = np.full((2, len(words)), len(rank)), np.full((2, len(words)), -1)
        for k, side in enumerate(sides):
            side = side[code[side] >= 0]
            np.minimum.at(earliest[k], code[side], rank[side])
            np.maximum.at(latest[k], code[side], rank[side])
        meet = (earliest[0][:, None] < latest[1][None, :]) | (earliest[1][:, None] < latest[0][None, :])
        np.fill_diagonal(meet, False)
        m, n = np.nonzero(_likely(words, meet))
        asked, ratios = m * len(words) + n, np.fromiter((ratio(words[i], words[j]) for i, j in zip(m, n, strict=True)), float, len(m))
        near = np.zeros((len(words) + 1, len(words) + 1), bool)  # the last row and column are null texts
        near[m, n] = ratios >= LEX_WEAK
        if copies:
            np.fill_diagonal(near[:-1, :-1], True)
        worded = near.any(0) | near.any(1)

        out = [(rows[:0], rows[:0], np.zeros(0))]  # a block may be empty
        for lo in range(0, len(sides[0]), SLICE):
            x, y = sides[0][lo : lo + SLICE], sides[1] if crossed else sides[1][lo:]
            cos = cosines(x, y)
            keep = cos >= COS_WEAK
            p, q = np.flatnonzero(worded[code[x]]), np.flatnonzero(worded[code[y]])
            if len(p) and len(q):
                before, m, n = rank[x[p], None] < rank[None, y[q]], code[x[p]], code[y[q]]
                keep[np.ix_(p, q)] |= np.where(before, near[m][:, n], near.T[m][:, n])
            at = np.flatnonzero(keep)  # faster than places of two dimensions
            cos, x, y = cos.ravel()[at], x[at // len(y)], y[at % len(y)]
            if crossed:
                x, y = np.where(rank[x] < rank[y], x, y), np.where(rank[x] < rank[y], y, x)
            wanted = rank[x] < rank[y]
            if not copies:
                wanted &= (code[x] != code[y]) | (code[x] < 0)
            out.append((x[wanted], y[wanted], cos[wanted]))
        x, y, cos = (np.concatenate(c) for c in zip(*out, strict=True))
        # wordings of the pairs that are left; vectors may be close where wordings are far apart
        lex, worded = np.where(code[x] == code[y], 1.0, np.nan), (code[x] >= 0) & (code[y] >= 0)
        lex[~worded] = np.nan
        apart = np.flatnonzero(worded & (code[x] != code[y]))
        both, place = np.unique(code[x[apart]].astype(np.int64) * len(words) + code[y[apart]], return_inverse=True)
        at = np.searchsorted(asked, both)
        have = np.append(asked, -1)[at] == both
        each = np.append(ratios, np.nan)[at]
        each[~have] = [ratio(words[k // len(words)], words[k % len(words)]) for k in both[~have].tolist()]
        lex[apart] = each[place]
        strong = (lex >= LEX_STRONG) & (negated[x] == negated[y])
        x, y = pa.array(x, pa.int64()), pa.array(y, pa.int64())
        return pa.table(
            [table.column(by).take(x), ords.take(x), ords.take(y), pa.array(np.where(strong, "strong", "weak"), pa.string()), pa.array(lex, pa.float64(), from_pandas=True), pa.array(cos, pa.float64(), from_pandas=True)],
            names=[by, "a", "b", "strength", "lex", "cos"],
        )

    return tile


def confirm_variants(pairs: DataFrame, answers: DataFrame | Column, by: str) -> DataFrame:
    """The pairs after a batched confirmation: a different claim goes, others become strong.

    ``answers`` are rows (by, a, b, relation), or the relation as a column of the pairs. A pair without an answer, or
    with one that is no known relation, keeps what the heuristic said.
    """
    known = ("restatement", "hedged_variant", "different_claim")
    if isinstance(answers, Column):
        rows = pairs.withColumn("relation", F.when(answers.isin(*known), answers))
    else:
        rows = pairs.join(answers.where(F.col("relation").isin(*known)), [by, "a", "b"], "left")
    rows = rows.where("relation is null or relation <> 'different_claim'")
    return rows.withColumn("strength", F.when(F.col("relation").isNotNull(), "strong").otherwise(F.col("strength")))


def variant_groups(pairs: DataFrame, by: str) -> DataFrame:
    """by, canonical, member: the components of strong pairs; the earliest claim of each is canonical."""
    strong = cut(pairs.where("strength = 'strong'").select(by, "a", "b"))
    # node ids that are unique across maps and keep each map's order
    code = lambda c: F.col(by).cast("long") * F.lit(1 << 24) + F.col(c)
    parts = graph.components(strong.select(code("a").alias("a"), code("b").alias("b")), "a", "b")
    split = lambda c: F.pmod(F.col(c), F.lit(1 << 24))
    return parts.select(F.floor(F.col("node") / F.lit(1 << 24)).alias(by), split("root").alias("canonical"), split("node").alias("member"))


def confirm_independence(pairs: DataFrame, cited: DataFrame, answers: DataFrame) -> DataFrame:
    """a, b, strength, asked: only pairs that some claim cites together are asked about, and an answer can only weaken.

    ``pairs`` (a, b, strength) with a < b; ``cited`` (claim, src); ``answers`` (a, b, independent), null if unreadable.
    """
    both = cited.select("claim", F.col("src").alias("a")).join(cited.select("claim", F.col("src").alias("b")), "claim").where("a < b").select("a", "b").distinct().withColumn("asked", F.lit(True))
    rows = pairs.join(both, ["a", "b"], "left").join(answers, ["a", "b"], "left").withColumn("asked", F.coalesce("asked", F.lit(False)))
    weaker = F.col("asked") & F.coalesce("independent", F.lit(False)) & (F.col("strength") == "strong")
    return rows.select("a", "b", F.when(weaker, "weak").otherwise(F.col("strength")).alias("strength"), "asked")


def propose_replacements(marks: DataFrame, candidates: DataFrame, downloads: DataFrame, top: int = 3) -> DataFrame:
    """claim, paper, key, registered, suggested of the best fetchable papers for claims marked as wrongly sourced.

    ``marks`` (claim, mark); ``candidates`` (claim, paper, relevance, surname, year, title, doi, url); ``downloads``
    (paper, outcome, filename). Keys are minted over all proposals; the first usable download of a claim is suggested.
    """
    wrong = marks.where("mark = 'wrong_source'").select("claim")
    fetchable = candidates.join(wrong, "claim", "left_semi").where((F.coalesce("doi", F.lit("")) != "") | (F.coalesce("url", F.lit("")) != ""))
    best = fetchable.withColumn("n", retrieve.rank(["claim"], F.col("relevance").desc(), F.col("paper"))).where(F.col("n") < top)
    keyed = sequential.mint_keys(best.withColumn("ord", F.struct("claim", "n")))
    rows = keyed.join(downloads, "paper", "left")
    usable = F.coalesce(F.col("outcome").isin("saved_pdf", "saved_text") & F.col("filename").isNotNull(), F.lit(False))
    rows = rows.withColumn("registered", usable)
    first = rows.where("registered").groupBy("claim").agg(F.min("n").alias("first"))
    return rows.join(first, "claim", "left").select("claim", "paper", "key", "registered", F.coalesce(F.col("n") == F.col("first"), F.lit(False)).alias("suggested"))


@F.pandas_udf(T.StructType([T.StructField("lo", T.IntegerType()), T.StructField("hi", T.IntegerType())]))
def section_bounds(words: pd.Series, best: pd.Series) -> pd.DataFrame:
    """The chunks around the best one, taken in turns from either side until the section has its words."""

    def grow(n: list[int], k: int) -> tuple[int, int]:
        lo = hi = int(k)
        total = n[lo]
        while total < SECTION_WORDS and (lo > 0 or hi < len(n) - 1):
            if lo > 0:
                lo -= 1
                total += n[lo]
            if total < SECTION_WORDS and hi < len(n) - 1:
                hi += 1
                total += n[hi]
        return lo, hi

    return pd.DataFrame([grow(list(n), k) for n, k in zip(words, best, strict=True)], columns=["lo", "hi"])


def relevant_section(chunks: DataFrame, by: list[str]) -> DataFrame:
    """by, lo, hi: the chunks (by, chunk, words, score) that are read: all of a short source, else those around the best."""
    rows = chunks.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("chunk", "words")))["words"].alias("n"), F.max_by("chunk", F.struct("score", -F.col("chunk"))).alias("best"), F.sum("words").alias("total"))
    grown = rows.withColumn("s", section_bounds("n", "best"))
    whole = F.col("total") <= WHOLE_WORDS
    return grown.select(*by, F.when(whole, 0).otherwise(F.col("s.lo")).alias("lo"), F.when(whole, F.size("n") - 1).otherwise(F.col("s.hi")).alias("hi"))


def engineered_outcome(kind: Column, verdict: Column, uncovered: Column, anchored: Column, gap_shown: Column, gap_in_reason: Column, over_cited: Column) -> Column:
    """pass, watch or fail of an expectation that a synthetic document was made for; null verdict is a missing claim.

    ``uncovered``: parts are left open; ``anchored``: every anchor is in a shown proof; ``gap_shown``: an open part names
    the gap; ``gap_in_reason``: the reason does.
    """
    supported = verdict == "supported"
    return (
        F.when(verdict.isNull(), "fail")
        .when(kind == "expect_full", F.when(supported & ~uncovered & anchored, "pass").otherwise("fail"))
        .when(kind == "expect_partial", F.when(supported & gap_shown, "pass").when(~supported & gap_in_reason, "watch").otherwise("fail"))
        .when(kind == "expect_unsupported", F.when(supported, "fail").otherwise("pass"))
        .when(kind == "expect_overcite", F.when(~supported, "fail").when(over_cited, "pass").otherwise("watch"))
        .when(kind == "watch_decontext", "watch")
        .otherwise("pass")
    )
