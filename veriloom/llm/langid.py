"""Language identification as inference of a mixture: every document has proportions of the learned languages.

Learning counts byte trigrams of words, with the word's edges, by language, on a sample of labelled rows that is
bounded by ``per_language`` rows in expectation and chosen by a hash of doc_id. A word's likelihood in a language is
the product over its trigrams, with a floor for words that no language explains. Expectation-maximisation over a
document's words gives the proportions; languages enter in the order of their proportions as long as the
likelihood, less a penalty for each language, grows. The prediction is the largest share in the chosen set.

Defined cases: a null or empty text, or one without a letter, is ``und`` with score 0, and so is every text where no
label was learned; letters that no language explains go to the likelier language; equal shares go to the language
first in order; repeated rows are predicted alike; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import parts, text_or_empty
from .hashing import joined, words

UND = "und"
PER_LANGUAGE = 1500
CODES = 1 << 16
PENALTY = 4.0
FLOOR = -9.0  # a word's likelihood is at least e^FLOOR of its likelihood in the best language
ROUNDS = 8
#: ASCII bytes that are not letters
NO_LETTER = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])


def held_out() -> Column:
    """Rows that are never learned from: crc32 of doc_id as text, mod 4, is 2."""
    return F.pmod(F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "utf-8")), F.lit(4)) == 2


def word_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram codes of all words, each word's first code, and each text's first word."""
    data, bounds = joined([b" " + t.lower().encode("utf-8", "replace") + b" " for t in texts])
    data = np.where(NO_LETTER[data], np.uint8(32), data)
    starts, ends, firsts = words(data, bounds, NO_LETTER)
    length = ends - starts
    first = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(length, out=first[1:])
    at = np.arange(first[-1]) - np.repeat(first[:-1] - starts + 1, length)
    wide = data.astype(np.uint32)
    codes = (wide[at] * np.uint32(0x9E3779B1)) ^ (wide[at + 1] * np.uint32(0x85EBCA6B)) ^ (wide[at + 2] * np.uint32(0xC2B2AE35))
    codes ^= codes >> np.uint32(15)
    return (codes * np.uint32(0x2C1B3C6D)) >> np.uint32(16), first, firsts


@dataclass
class Model:
    languages: list[str]
    logs: np.ndarray  # codes x languages

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, list[str], list[float]]]:
        texts = [t or "" for t in texts]
        if not self.languages:
            return [(UND, 0.0, [], [])] * len(texts)
        codes, first, firsts = word_codes(texts)
        counts = np.diff(firsts)
        out = [(UND, 0.0, [], [])] * len(texts)
        some = [k for k in np.flatnonzero(counts).tolist() if any(map(str.isalpha, texts[k]))]
        if not some:
            return out
        likely = np.add.reduceat(self.logs[codes], first[:-1], axis=0) if len(first) > 1 else np.zeros((0, len(self.languages)), np.float32)
        likely -= likely.max(axis=1, keepdims=True)
        ratio = np.exp(np.maximum(likely, FLOOR))
        held = np.flatnonzero(counts)
        share, sets = mixtures(ratio, counts[held])
        slot = {k: n for n, k in enumerate(held.tolist())}
        for k in some:
            row = share[slot[k]]
            order = np.argsort(-row, kind="stable")[: sets[slot[k]]]
            out[k] = (self.languages[order[0]], float(min(1.0, row[order[0]])), [self.languages[i] for i in order], [float(row[i]) for i in order])
        return out


def em(ratio: np.ndarray, counts: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions by document over the allowed languages, and the log-likelihoods that they reach."""
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    share = allowed / allowed.sum(axis=1, keepdims=True)
    share = share.astype(np.float32)
    for _ in range(ROUNDS):
        part = ratio * np.repeat(share, counts, axis=0)
        part /= part.sum(axis=1, keepdims=True)
        share = np.add.reduceat(part, first, axis=0) / counts[:, None].astype(np.float32)
    total = (ratio * np.repeat(share, counts, axis=0)).sum(axis=1, dtype=np.float64)
    return share, np.add.reduceat(np.log(np.maximum(total, 1e-30)), first)


def mixtures(ratio: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document's proportions over its chosen languages, and how many are chosen."""
    n, width = len(counts), ratio.shape[1]
    full, _ = em(ratio, counts, np.ones((n, width)))
    place = np.argsort(np.argsort(-full, axis=1, kind="stable"), axis=1, kind="stable")
    best = (place == 0).astype(np.float32)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    reached = np.add.reduceat(np.log(np.maximum((ratio * np.repeat(best, counts, axis=0)).sum(axis=1, dtype=np.float64), 1e-30)), first)
    size, open_ = np.ones(n, np.int64), np.arange(n)
    for k in range(2, width + 1):
        if not len(open_):
            break
        rows = np.zeros(n, bool)
        rows[open_] = True
        share, likely = em(ratio[np.repeat(rows, counts)], counts[open_], (place[open_] < k).astype(np.float64))
        better = likely - reached[open_] > PENALTY + 0.5 * np.log(counts[open_])
        open_ = open_[better]
        best[open_], reached[open_], size[open_] = share[better], likely[better], k
    return best, size


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Trigram counts by language, over a hashed sample of the labelled rows that are not held out."""
    labelled = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), text_or_empty().alias("text"))
    labelled = labelled.where(F.col("lang").isNotNull() & ~held_out())
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not sizes:
        return Model([], np.zeros((CODES, 0), np.float32))
    scale = 1 << 20
    quota = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(scale, -(-per_language * scale // n)))])
    sample = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(scale)) < quota[F.col("lang")]).select("lang", "text")

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in parts(batches, 1):
            langs = np.array(batch.column(0).to_pylist(), dtype=object)
            texts = batch.column(1).to_pylist()
            for lang in set(langs):
                codes, _, _ = word_codes([texts[k] for k in np.flatnonzero(langs == lang)])
                sums[lang] = sums.get(lang, 0) + np.bincount(codes, minlength=CODES)
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(at), "code": pa.array(at, pa.int32()), "n": pa.array(n[at], pa.int64())})

    counted = sample.mapInArrow(count, "lang string, code int, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(sizes)
    table = np.zeros((CODES, len(languages)))
    for k, lang in enumerate(languages):
        own = counted[counted.lang == lang]
        table[own.code.to_numpy(), k] = own.n.to_numpy()
    table += 0.5
    return Model(languages, np.log(table / table.sum(axis=0)).astype(np.float32))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, and the chosen languages with their shares."""

    def work(batches):
        for batch in parts(batches, 2):
            got = model.predict(batch.column(2).to_pylist())
            columns = [batch.column(0), batch.column(1), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.list_(pa.string())), pa.array([g[3] for g in got], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "lang_pred", "score", "languages", "shares"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), text_or_empty().alias("text"))
    return rows.mapInArrow(work, "doc_id long, held_out boolean, lang_pred string, score double, languages array<string>, shares array<double>")


def keep_identified(docs: DataFrame, model: Model, languages: list[str] | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, with a language: any learned one, or one of ``languages``."""
    at = docs.columns.index("text")

    def work(batches):
        for batch in parts(batches, at):
            got = model.predict(batch.column(at).to_pylist())
            yield batch.filter(pa.array([g[0] != UND and (languages is None or g[0] in languages) for g in got], pa.bool_()))

    return docs.mapInArrow(work, T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema.fields]))
