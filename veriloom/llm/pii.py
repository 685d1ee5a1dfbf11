"""Personal data with the offsets of the source, also where it is disguised.

Base spans are what the plain patterns find in the text as it is. A chain of transducers then rewrites the text,
each keeping for every character of its output the span of source characters it stands for: look-alike and
full-width characters become ASCII, invisible ones vanish, spelled digits among digits become digits (with "plus"
before them a sign), and "(at)", "AT", "dot" or "[.]" in an address become signs. The same patterns run on the
result; what they find there by help of a rewritten character is mapped back to the source and added, unless a base
span of its kind overlaps it; one that holds such base spans whole and more text is added beside them.

A bare "at" or "dot" is a word of prose as well: an address written with bare words only needs a spelled dot and a
known last label, one with a capital "AT" a known last label; brackets need neither.

Defined cases: null counts as empty and has no spans; ties in start are ordered by kind; repeated rows are each
reported; an empty table gives no rows; other columns of the input are not read. Every pattern takes time linear in
the text, whatever its runs of digits, letters, signs or spaces: each looks at a bounded stretch around a sign, or
runs on without stepping back.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGITS = re.compile("[0-9]")

# Characters that look like an ASCII one, the words for digits and signs, and last labels of hosts.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "І": "I",
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "ι": "i", "κ": "k", "τ": "t", "Α": "A", "Β": "B", "Ε": "E", "Ο": "O", "Ρ": "P",
    "ɡ": "g", "ı": "i", "ℓ": "l", "․": ".", "‧": ".", "。": ".", "∙": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-",
}
SPELLED = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
AT_WORDS, DOT_WORDS = "at|arroba", "dot|punkt|punto"
LAST_LABELS = frozenset("com org net edu gov mil int info biz name io co eu de fr es it uk us ca au ch at nl be pt pl se no dk fi ie in jp cn br mx ar cl test example invalid".split())
INVISIBLE = frozenset("​‌‍⁠﻿­")

_digit = "|".join(sorted(SPELLED, key=len, reverse=True))
_word = rf"(?:{_digit})(?![^\W\d_])"
_open, _close = r"[\[({<]\s{0,3}", r"\s{0,3}[\])}>]"
_dot = rf"\s{{0,3}}{_open}(?:{DOT_WORDS}|\.){_close}\s{{0,3}}|\s{{1,3}}(?:{DOT_WORDS})\s{{1,3}}"
SPELLED_RUN = re.compile(rf"(?<![^\W_])(?:plus {{1,2}})?(?:{_word}|[0-9]++)(?:(?:[ \-,.]{{1,2}}|{_dot})(?:{_word}|[0-9]++))++", re.I)
SPELLED_PART = re.compile(rf"(plus {{1,2}})|({_word})|([0-9]+)|({_dot})|([ \-,.]+)", re.I)
ANY_WORD = re.compile(_word, re.I)
AT = re.compile(rf"\s{{0,3}}{_open}(?:{AT_WORDS}|@){_close}\s{{0,3}}|\s{{1,3}}(?:{AT_WORDS})\s{{1,3}}|\s{{0,3}}@\s{{0,3}}", re.I)
SPELLED_DOMAIN = re.compile(rf"[A-Za-z0-9-]++(?:(?:{_dot}|\.)[A-Za-z0-9-]++)++", re.I)
SPELLED_DOT = re.compile(_dot, re.I)
NUMBER_DOT = re.compile(rf"(?<=[0-9])(?:{_dot})(?=[0-9])", re.I)
HINT = re.compile(
    rf"{_open}(?:{AT_WORDS}|{DOT_WORDS}|@|\.){_close}|\s(?:{DOT_WORDS})\s|\s(?-i:AT)\s|\s@|@\s"
    rf"|(?<![^\W_]){_word}[ \-,.]{{1,2}}(?:{_word}|[0-9])|[0-9][ \-,.]{{1,2}}{_word}",
    re.I,
)


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if k % 2:
            v = v * 2 - 9 * (v > 4)
        total += v
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses, from each at sign outwards."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            found.append((start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return found


def plain_spans(text: str) -> list[tuple[str, int, int]]:
    """The base spans, by start and then kind."""
    found = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if DIGITS.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                found.append(("ip", *m.span()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                found.append(("card", *m.span()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= len(DIGITS.findall(m[0])) <= 15:
                    found.append(("phone", *m.span()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


class Traced:
    """A text whose every character knows the source span it stands for, and whether it was rewritten."""

    def __init__(self, text: str):
        self.text, self.at, self.end, self.new = text, list(range(len(text))), list(range(1, len(text) + 1)), [False] * len(text)

    def put(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace spans of the present text, given in order; each new character stands for its whole span."""
        text, at, end, new, last = [], [], [], [], 0
        for a, b, to in edits:
            text += [self.text[last:a], to]
            at += self.at[last:a] + [self.at[a]] * len(to)
            end += self.end[last:a] + [self.end[b - 1]] * len(to)
            new += self.new[last:a] + [True] * len(to)
            last = b
        self.text = "".join([*text, self.text[last:]])
        self.at, self.end, self.new = at + self.at[last:], end + self.end[last:], new + self.new[last:]


def _look(c: str) -> str | None:
    if c in INVISIBLE:
        return ""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    if "！" <= c <= "～" or "\U0001d400" <= c <= "\U0001d7ff":
        plain = unicodedata.normalize("NFKC", c)
        return plain if len(plain) == 1 and plain.isascii() else None
    return str(unicodedata.digit(c)) if not c.isascii() and c.isdecimal() else None


def homoglyphs(t: Traced) -> None:
    known = {c: to for c in set(t.text) if not c.isascii() and (to := _look(c)) is not None}
    if known:
        t.put([(k, k + 1, known[c]) for k, c in enumerate(t.text) if c in known])


def spelled_digits(t: Traced) -> None:
    """Digit words beside digits or each other: words in a row close up, other separators become one sign."""
    edits = []
    for m in SPELLED_RUN.finditer(t.text):
        if not ANY_WORD.search(m[0]):
            continue
        gap, before = None, ""
        for p in SPELLED_PART.finditer(t.text, *m.span()):
            if p[1]:
                edits.append((*p.span(), "+"))
            elif p[4] or p[5]:
                gap = p
            else:
                now = "word" if p[2] else "digits"
                if gap is not None:
                    if gap[4] or (gap[0] == "." and "word" in (before, now)):
                        edits.append((*gap.span(), "."))
                    elif "word" in (before, now):
                        edits.append((*gap.span(), "" if before == now else " "))
                if p[2]:
                    edits.append((*p.span(), SPELLED[p[2].lower()]))
                gap, before = None, now
    if edits:
        t.put(edits)


def at_and_dot(t: Traced) -> None:
    """Spelled signs of addresses become signs, outwards from each "at"; spelled dots between numbers likewise."""
    text, edits, free = t.text, [], 0
    for m in AT.finditer(text):
        start = m.start()
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        domain = SPELLED_DOMAIN.match(text, m.end())
        if start == m.start() or not domain:
            continue
        dots = [d.span() for d in SPELLED_DOT.finditer(text, *domain.span())]
        sign, known = m[0].strip(), re.split(r"[\s.\])}>]", domain[0])[-1].lower() in LAST_LABELS
        bracketed = sign[0] in "[({<" or any("[" in text[a:b] or "(" in text[a:b] or "{" in text[a:b] or "<" in text[a:b] for a, b in dots)
        loud = sign == "AT" and text[start : m.start()] != text[start : m.start()].upper()
        if m[0] == "@" and not dots or not (bracketed or known and (dots or loud or "@" in sign)):
            continue
        edits += [(*m.span(), "@"), *[(a, b, ".") for a, b in dots]]
        free = domain.end()
    taken = {e[:2] for e in edits}
    edits += [(*m.span(), ".") for m in NUMBER_DOT.finditer(text) if m.span() not in taken]
    if edits:
        t.put(sorted(edits))


def disguised_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans found only in the rewritten text."""
    if not HINT.search(text) and (text.isascii() or not any(_look(c) is not None for c in set(text) if not c.isascii())):
        return []
    t = Traced(text)
    for step in (homoglyphs, spelled_digits, at_and_dot):
        step(t)
    held = {kind: [s[1:] for s in base if s[0] == kind] for kind in KINDS}
    found, free = [], dict.fromkeys(KINDS, 0)
    for kind, a, b in plain_spans(t.text):
        start, end = t.at[a], t.end[b - 1]
        if start < free[kind] or not (any(t.new[a:b]) or end - start != b - a):
            continue
        first, last = bisect_right(held[kind], start, key=lambda s: s[1]), bisect_left(held[kind], end, key=lambda s: s[0])
        over = held[kind][first:last]
        if not over or start <= over[0][0] and over[-1][1] <= end and (start, end) != over[0]:
            free[kind] = end
            found.append((kind, start, end))
    return found


def find_spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """All spans, and the base ones among them, each by start and then kind."""
    base = plain_spans(text)
    more = disguised_spans(text, base)
    return (sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0]))) if more else base), base


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join([f"{k}:{a}:{b}" for k, a, b in spans])


def find_pii(docs: DataFrame) -> DataFrame:
    """One row per document: counts by kind, the hash of the base spans, all spans, and the number of base spans."""

    def work(batches):
        for batch in batches:
            out = {"doc_id": batch.column(0).to_pylist(), **{f"n_{k}": [] for k in KINDS}, "base_sha256": [], "spans": [], "n_base": []}
            for value in batch.column(1):
                spans, base = find_spans(value.as_py())
                for kind in KINDS:
                    out[f"n_{kind}"].append(sum(s[0] == kind for s in spans))
                out["base_sha256"].append(hashlib.sha256(_joined(base).encode()).hexdigest())
                out["spans"].append(_joined(spans))
                out["n_base"].append(len(base))
            kinds = {"base_sha256": pa.string(), "spans": pa.string()}
            yield pa.RecordBatch.from_arrays([pa.array(v, kinds.get(c, pa.int64())) for c, v in out.items()], names=list(out))

    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_base long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(work, schema)


def mask_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every found span of ``text`` replaced by its kind in brackets; the other columns stay."""
    at, schema = docs.columns.index(text), docs.schema

    def masked(value: str | None) -> str | None:
        if value is None:
            return None
        parts, last = [], 0
        for kind, a, b in find_spans(value)[0]:
            if a >= last:
                parts += [value[last:a], f"[{kind.upper()}]"]
            last = max(last, b)
        return "".join([*parts, value[last:]])

    def work(batches):
        for batch in batches:
            new = pa.array([masked(v.as_py()) for v in batch.column(at)], pa.string())
            yield pa.RecordBatch.from_arrays([new if k == at else batch.column(k) for k in range(batch.num_columns)], names=batch.schema.names)

    return docs.mapInArrow(work, schema)
