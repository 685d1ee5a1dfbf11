"""Operators whose definition is a scan in order: folds with a reset, greedy choices, order-sensitive similarity."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lineage import cut


@F.pandas_udf(T.DoubleType())
def sequence_ratio(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Order-sensitive similarity of two normalised texts; the order of the arguments matters."""
    for a, b in pairs:
        yield pd.Series([SequenceMatcher(None, x, y).ratio() if x is not None and y is not None else None for x, y in zip(a, b, strict=True)], dtype="float64")


def longest_common(a: str, b: str) -> int:
    """Length of the longest string in both, by bisection over lengths with fingerprints of all strings of one length."""
    factor, sides = np.uint64(0x9E3779B97F4A7C15), []
    with np.errstate(over="ignore"):
        for s in (a, b):
            powers = [(np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)) * factor]
            while 2 << (len(powers) - 1) <= min(len(a), len(b)):
                k, x = 1 << (len(powers) - 1), powers[-1]
                x = (x[:-k] ^ (x[:-k] >> np.uint64(29))) * factor + x[k:]
                powers.append(x ^ (x >> np.uint64(31)))
            sides.append(powers)

        def prints(powers: list, k: int) -> np.ndarray:
            t = k.bit_length() - 1
            x, rest = powers[t], k - (1 << t)
            return x * factor + x[rest:] if not rest else x[:-rest] * factor + x[rest:]

        low, high = 0, min(len(a), len(b))
        while low < high:
            k = (low + high + 1) // 2
            if np.isin(prints(sides[0], k), prints(sides[1], k)).any():
                low = k
            else:
                high = k - 1
    return low


@F.pandas_udf(T.DoubleType())
def longest_block(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Length of the longest common block over the length of the first text; 1 where it is contained."""
    for a, b in pairs:
        out = []
        for quote, text in zip(a, b, strict=True):
            if not quote or text is None:
                out.append(0.0)
            elif quote in text:
                out.append(1.0)
            else:
                out.append(longest_common(quote, text) / len(quote))
        yield pd.Series(out, dtype="float64")


def chunk_numbers(counts: Column, most: int = 1200) -> Column:
    """For each sentence's number of words its chunk; a chunk closes with the sentence that fills it."""

    def step(state: Column, n: Column) -> Column:
        total = state["words"] + n
        return F.struct(F.concat(state["out"], F.array(state["chunk"])).alias("out"), F.when(total >= most, state["chunk"] + 1).otherwise(state["chunk"]).alias("chunk"), F.when(total >= most, 0).otherwise(total).alias("words"))

    start = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("chunk"), F.lit(0).alias("words"))
    return F.aggregate(counts, start, step, lambda s: s["out"])


def paragraph_chunks(counts: Column, most: int = 1200) -> Column:
    """As ``chunk_numbers``, but a chunk closes before the paragraph that would overflow it."""

    def step(state: Column, n: Column) -> Column:
        full = (state["words"] > 0) & (state["words"] + n > most)
        chunk = F.when(full, state["chunk"] + 1).otherwise(state["chunk"])
        return F.struct(F.concat(state["out"], F.array(chunk)).alias("out"), chunk.alias("chunk"), F.when(full, n).otherwise(state["words"] + n).alias("words"))

    start = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("chunk"), F.lit(0).alias("words"))
    return F.aggregate(counts, start, step, lambda s: s["out"])


def merge_fragments(sentences: list[str], words: int = 4, chars: int = 60, most_words: int = 50, most_chars: int = 400) -> list[str]:
    """Runs of two or more short sentences become blocks within the caps; a lone one stays."""
    out: list[str] = []
    block: list[str] = []

    def close() -> None:
        if block:
            out.append(" ".join(block))
            block.clear()

    for s in sentences:
        if len(s.split()) > words or len(s) > chars:
            close()
            out.append(s)
            continue
        if block and (sum(len(x.split()) for x in block) + len(s.split()) > most_words or len(" ".join(block)) + 1 + len(s) > most_chars):
            close()
        block.append(s)
    close()
    return out


def wrap_long(sentence: str, lines: list[str], most: int = 600, width: int = 300) -> list[str]:
    """A sentence that segmentation failed on: cut at its source lines if it has several, else wrapped at words."""
    if len(sentence) <= most:
        return [sentence]
    parts = [x.strip() for x in lines if x.strip()] if len(lines) > 1 else [sentence]
    out: list[str] = []
    for part in parts:
        while len(part) > most:
            at = part.rfind(" ", 1, width + 1)
            at = at if at > 0 else width
            out.append(part[:at].strip())
            part = part[at:].strip()
        if part:
            out.append(part)
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def source_sentences(texts: pd.Series) -> pd.Series:
    """Sentences of a source: long ones cut at their lines, short neighbours merged."""
    import re

    def split(text: str | None) -> list[str]:
        if not text:
            return []
        out: list[str] = []
        for part in re.split(r"(?<=[.!?])\s+", text.strip()):
            flat = " ".join(part.split())
            if flat:
                out += wrap_long(flat, [" ".join(x.split()) for x in part.splitlines()])
        return merge_fragments(out)

    return texts.map(split)


def greedy_pairs(pairs: DataFrame, most: int = 3) -> DataFrame:
    """Pairs (a, b, cos) taken from the best down; a pair is skipped if either end has ``most`` already.

    A pair that is among the best free places of both its ends is taken whatever the others do, so all of these are
    taken at once, round by round; each round takes the best pair that is left at least. No group is held in one task.
    """
    left, taken = cut(pairs.select("a", "b", "cos")), None
    while not left.isEmpty():
        ends = left.withColumn("node", F.explode(F.array("a", "b")))
        order = F.row_number().over(Window.partitionBy("node").orderBy(F.col("cos").desc(), "a", "b"))
        places = F.lit(most)
        ranked = ends.withColumn("n", order)
        if taken is not None:
            held = taken.withColumn("node", F.explode(F.array("a", "b"))).groupBy("node").agg(F.count("*").alias("held"))
            ranked, places = ranked.join(held, "node", "left"), F.lit(most) - F.coalesce("held", F.lit(0))
        judged = cut(ranked.groupBy("a", "b", "cos").agg(F.bool_and(F.col("n") <= places).alias("sure"), F.bool_or(places <= 0).alias("full")))
        fresh = judged.where("sure").select("a", "b", "cos")
        taken = cut(fresh if taken is None else taken.unionByName(fresh))
        left = cut(judged.where("not sure and not full").select("a", "b", "cos"))
    return pairs.select("a", "b", "cos").where("false") if taken is None else taken


def fuzzy_rematch(left: DataFrame, right: DataFrame, block: str, least: float = 0.6, bonus: float = 0.05) -> DataFrame:
    """(new_id, old_id): leftovers of two runs matched greedily in order by the best ratio within a block; each old one once.

    ``left`` has (block, new_id, text, markers), ``right`` (block, old_id, text, markers); equal markers add a bonus.
    A block is one document's leftovers: it is matched in order by one task and must fit there.
    """

    def choose(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        free, kept = {r.old_id: (r.text, r.markers) for r in b.sort_values("old_id").itertuples(index=False)}, []
        for r in a.sort_values("new_id").itertuples(index=False):
            best, score = None, least
            for old, (text, markers) in free.items():
                ratio = SequenceMatcher(None, r.text, text).ratio() + (bonus if markers == r.markers else 0.0)
                if ratio > score or (best is None and ratio >= score):
                    best, score = old, ratio
            if best is not None:
                kept.append((r.new_id, best))
                del free[best]
        return pd.DataFrame(kept, columns=["new_id", "old_id"])

    return left.groupBy(block).cogroup(right.groupBy(block)).applyInPandas(choose, "new_id long, old_id long")


def mint_keys(rows: DataFrame) -> DataFrame:
    """Citation keys from surname and year (title's first long word without a surname); repeats get _2, _3 in order."""
    word = F.element_at(F.filter(F.split(F.regexp_replace(F.lower("title"), "[^a-z0-9 ]", " "), " +"), lambda w: F.length(w) > 3), 1)
    base = F.concat(F.coalesce(F.nullif(F.regexp_replace(F.lower("surname"), "[^a-z]", ""), F.lit("")), word, F.lit("source")), F.coalesce("year", F.lit("")))
    keyed = rows.withColumn("base", base)
    n = F.row_number().over(Window.partitionBy("base").orderBy("ord"))
    return keyed.withColumn("key", F.when(n == 1, F.col("base")).otherwise(F.concat("base", F.lit("_"), n))).drop("base")
