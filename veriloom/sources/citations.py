"""Author-year citations, and moving citations to the ends of their sentences.

Recognising is pure: a text gives mentions with their place. Whether a mention stands for one known entry is a join,
unique or refused; a parenthesis counts as a whole or not at all. Then the spans and keys of a text come together
again and are cut out and set as markers at the end of the sentence each stood in.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.evidence import fold
from .bibliography import numeric_citations, pandoc_keys

# What years, citations in parentheses and names before a year look like, and where no sentence ends.
YEAR = r"(?:1[89]|20)\d{2}"
ABBREVIATIONS = ("et al", "e.g", "i.e", "cf", "vs", "etc", "fig", "figs", "no", "vol", "pp", "p", "ca", "approx", "dr", "prof", "mr", "ms", "st")
PAREN = re.compile(rf"\(([^()]*\b{YEAR}[a-z]?\b[^()]*)\)")
NARRATIVE = re.compile(rf"\b([A-Z][\w'’-]+)(?:\s+(?:et al\.?|(?:and|&)\s+[A-Z][\w'’-]+))?\s*(\(\s*({YEAR})[a-z]?\s*\))")
YEARS, SURNAME = re.compile(rf"\b({YEAR})[a-z]?\b"), re.compile(r"[A-Z][\w'’-]+")
STOP = re.compile(r"[.!?](?=[\"')\]]*(?:\s|$))")
NO_STOP = re.compile(rf"(?:{'|'.join(re.escape(a) for a in ABBREVIATIONS)})$", re.I)
INITIAL = re.compile(r"(?:^|\s)[A-Z]$")


def mentions(text: str | None) -> list[tuple[int, int, str, str]]:
    """start, end, surname, year: every year of every named segment of a parenthesis, and names before a year in one."""
    found = []
    for m in PAREN.finditer(text or ""):
        for segment in m[1].split(";"):
            first = YEARS.search(segment)
            name = first and SURNAME.search(segment, 0, first.start())
            if name:
                found += [(m.start(), m.end(), name[0], y[1]) for y in YEARS.finditer(segment, first.start())]
    taken = {f[:2] for f in found}
    found += [(*m.span(2), m[1], m[3]) for m in NARRATIVE.finditer(text or "") if m.span(2) not in taken]
    return found


MENTION = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("surname", T.StringType()), T.StructField("year", T.StringType())])


@F.pandas_udf(T.ArrayType(MENTION))
def author_year(texts: pd.Series) -> pd.Series:
    return texts.map(lambda s: [dict(zip(("start", "end", "surname", "year"), m, strict=True)) for m in mentions(s)])


def sentence_end(text: str, start: int) -> int:
    """Just behind the signs that end the sentence around ``start``, or the end of the text."""
    for m in STOP.finditer(text, start):
        at = m.end() - 1
        if text[at] == "." and (NO_STOP.search(text[max(0, at - 8) : at]) or INITIAL.search(text[max(0, at - 2) : at])):
            continue
        return at + 1 + len(re.match(r"[\"')\]]*", text[at + 1 :])[0])
    return len(text)


def reinsert(text: str, cited: list[tuple[int, int, list[str]]]) -> str:
    """The text without its citations, and [[key]] markers at the end of the sentence that each stood in."""
    if not cited:
        return text
    hidden = list(text)
    for a, b, _ in cited:
        hidden[a:b] = "_" * (b - a)
    masked, at = "".join(hidden), {}
    for _, b, keys in sorted(cited):
        at.setdefault(sentence_end(masked, b), []).extend(keys)
    gone = {k for a, b, _ in cited for k in range(a, b)}
    out = []
    for k in range(len(text) + 1):
        if k in at:
            out.append(" " + " ".join(f"[[{key}]]" for key in dict.fromkeys(at[k])))
        if k < len(text) and k not in gone:
            out.append(text[k])
    return re.sub(r"[ \t]{2,}", " ", re.sub(r"[ \t]+([.,;:!?])", r"\1", "".join(out)))


@F.pandas_udf(T.StringType())
def with_markers(texts: pd.Series, cited: pd.Series) -> pd.Series:
    """``cited`` has arrays of (start, end, keys)."""
    return pd.Series([None if s is None else reinsert(s, [(c["start"], c["end"], list(c["keys"])) for c in (spans if spans is not None else [])]) for s, spans in zip(texts, cited, strict=True)], dtype=object)


def resolve(found: DataFrame, index: DataFrame, by: str) -> DataFrame:
    """by, start, end, keys, ok of each span of mentions (by, start, end, surname, year); null keys where one is not sure.

    ``index`` has (surname, year, key, first): a surname and year must name exactly one entry as first author, or, if
    none has it as first, exactly one as any author. One mention that does not resolve leaves its whole span out.
    """
    each = index.groupBy(fold("surname").alias("s"), F.col("year").alias("y")).agg(F.collect_set(F.when(F.col("first"), F.col("key"))).alias("first"), F.collect_set("key").alias("any"))
    rows = found.withColumn("s", fold("surname")).join(each.withColumnRenamed("y", "year"), ["s", "year"], "left")
    one = lambda c: F.when(F.size(c) == 1, F.get(c, 0))
    key = F.when(F.size("first") > 0, one(F.col("first"))).otherwise(one(F.col("any")))
    ranked = rows.withColumn("key", key).withColumn("n", F.row_number().over(Window.partitionBy(by, "start", "end").orderBy("pos")))
    spans = ranked.groupBy(by, "start", "end").agg(F.array_sort(F.collect_list(F.struct("n", "key")))["key"].alias("keys"), F.bool_and(F.col("key").isNotNull()).alias("ok"))
    return spans.withColumn("keys", F.when(F.col("ok"), F.col("keys")))


def convert(texts: DataFrame, index: DataFrame, by: str, text: str) -> DataFrame:
    """by, text: author-year citations that resolve, moved to their sentences' ends as markers."""
    found = texts.select(by, F.posexplode(author_year(F.col(text))).alias("pos", "m")).select(by, "pos", "m.*")
    sure = resolve(found, index, by).where("ok").groupBy(by).agg(F.collect_list(F.struct("start", "end", "keys")).alias("cited"))
    return texts.join(sure, by, "left").select(by, with_markers(F.col(text), F.col("cited")).alias("text"))


#: Recognisers by name: each takes a text column and gives an array of what it found; a further one is registered here.
RECOGNISERS = {"author-year": author_year, "numeric": numeric_citations, "pandoc": pandoc_keys}
