"""Names in a claim: its subject, its other entities, and what a proof must not leave out.

A sentence's words become a string of kinds, one letter a word; the runs that count are then regular expressions
over that string, so the rules of what continues or ends a name are read off one pattern.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that begin sentences without naming anything, and words and signs that shape a name.
COMMON = frozenset("""
the a an this that these those it its he she his her they their we our you your
i who what which where when why how there here one some any all both each every
many most few several no not nor and but or so yet if as at by for from in into
of on onto over under to with without within after before during since until
despite although though however moreover furthermore nevertheless meanwhile
additionally also besides thus hence therefore then while because unless once
again still even only just is are was were be been being have has had do does
did can could may might must shall should will would according beyond according
research researchers studies study reviews review results result data evidence
findings finding analysis analyses experts scientists critics reports report
estimates trials figure table section overall finally initially recently
english british american french german spanish italian dutch russian chinese
japanese korean indian african european asian australian canadian mexican
brazilian portuguese greek turkish polish swedish norwegian danish finnish
irish scottish welsh western eastern northern southern
""".split())
NO_NAME = frozenset("the a an in on at it this that these those but and for with from when while however although moreover most some many both english british".split())
PUNCTUATION = "\"'()[]{},.;:!?“”‘’"
LEAST = 3

NAME, ANY_NAME = re.compile(r"[A-Z][a-zA-Z'’-]*"), re.compile(r"[A-Z](?:[^\W\d_]|['’-])*")
#: n name, e name that a sign ends, c connector, C connector in capitals, X other word in capitals, x other word.
SPECIFIC = re.compile(r"(?=[ne])(?:n|[cC](?=[cC]?+[neXC]))*e?")
#: a leading article, then as above; k is a connector of subjects.
SUBJECT = re.compile(r"a?((?=[ne])(?:n|k(?=[neX]))*e?)")
YEAR, PERCENT = re.compile(r"\b(?:1[6-9]|20)\d{2}\b"), re.compile(r"\b\d+(?:\.\d+)?\s?%")


def sentences(text: str) -> list[list[tuple[str, bool]]]:
    """Per sentence its words without the signs around them, and whether a sign ends each."""
    return [[(w.strip(PUNCTUATION), w[-1] in PUNCTUATION) for w in s.split()] for s in re.split(r"(?<=[.!?])\s+", text)]


def specifics(text: str | None) -> list[str]:
    """Runs of names (never a sentence's first word), years and percentages, each once whatever its case."""
    found = []
    for words in sentences(text or ""):
        kinds = ""
        for k, (w, ended) in enumerate(words):
            if NAME.fullmatch(w) and k and w.lower() not in NO_NAME:
                kinds += "e" if ended else "n"
            elif w.lower() in ("of", "the"):
                kinds += "C" if w[0].isupper() else "c"
            else:
                kinds += "X" if "A" <= w[:1] <= "Z" else "x"
        found += [" ".join(w for w, _ in words[m.start() : m.end()]) for m in SPECIFIC.finditer(kinds)]
    found += YEAR.findall(text or "") + PERCENT.findall(text or "")
    return list({s.lower(): s for s in reversed(found)}.values())[::-1]


def fold(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()


def common(word: str) -> bool:
    return word.lower() in COMMON or word.lower().rstrip("s") in COMMON


def subject(text: str | None) -> list[str]:
    """Folded words of the name that a claim opens with; none where it opens with no name that can be checked."""
    words, kinds = sentences((text or "").strip())[0], ""
    for k, (w, ended) in enumerate(words):
        if not k and w.lower() in ("the", "a", "an"):
            kinds += "a"
        elif ANY_NAME.fullmatch(w):
            kinds += "e" if ended else "n"
        elif w.lower() in ("of", "the", "de", "van", "von", "der"):
            kinds += "k"
        else:
            kinds += "X" if "A" <= w[:1] <= "Z" else "x"
    m = SUBJECT.match(kinds)
    run = [w for w, _ in words[m.start(1) : m.end(1)]] if m else []
    kept = [fold(w) for w in run if len(w) >= LEAST and not common(w)]
    return [] if len(run) == 1 and common(run[0]) or len(run) > 1 and len(kept) == 1 else kept


def entities(text: str | None) -> list[dict]:
    """The subject, and every other name of two checkable words or more: what a proving source must mention."""
    lead = subject(text)
    found = [{"display": " ".join(lead), "tokens": lead}] if lead else []
    for name in specifics(text):
        if "%" in name or any(c.isdigit() for c in name):
            continue
        whole = [w for w in name.split() if "-" not in w or w.rsplit("-", 1)[1][:1].isupper()]
        tokens = [fold(w) for w in whole if len(w) >= LEAST and not common(w)]
        if len(tokens) > 1:
            found.append({"display": name, "tokens": tokens})
    return found


@F.pandas_udf(T.ArrayType(T.StringType()))
def named_specifics(texts: pd.Series) -> pd.Series:
    return texts.map(specifics)


@F.pandas_udf(T.ArrayType(T.StringType()))
def subject_tokens(texts: pd.Series) -> pd.Series:
    return texts.map(subject)



@F.pandas_udf(T.ArrayType(T.StringType()))
def entity_lines(texts: pd.Series) -> pd.Series:
    """Each entity as its display form, a bar, and its words."""
    return texts.map(lambda s: [f"{e['display']}|{' '.join(e['tokens'])}" for e in entities(s)])
