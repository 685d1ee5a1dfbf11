"""Benchmark decontamination: windows as long as each item, SimHash, multi-index Hamming search, exact check.

Texts become shingles of five words (runs of letters, digits and non-ASCII characters, lower-cased). A window has
as many shingles as an item. Its 64-bit SimHash, with each shingle weighing its multiplicity, is looked up in eight
tables of 8 bits: of two fingerprints within ``radius`` bits, one block at least differs in radius // 8 bits or
fewer, so the tables give every item within the radius. A table has 256 masks with a bit for each item of one size. Candidates are then decided by the exact weighted
similarity of the two multisets of shingles, sum of minima over sum of maxima. A window that has no shingle in
common with an item has similarity 0, so only windows over a shared shingle are hashed.

The items are sent to the tasks in slices of bounded size, ``slice_bytes`` of text at most; a larger benchmark takes
several passes over the documents. A task's tables take 256 bytes an item, and windows are looked up in parts, so
that windows times items are bounded too. At similarity 0.8 the expected distance is 10 bits with deviation 3, so the
default radius of 20 keeps all but some 3 in 10,000 of the windows that are just similar enough.

Defined cases: a null or empty text, or an item without words, matches nothing; an item or text under five words is
one shingle; a document shorter than an item is one window; repeated item ids are reported once, repeated documents
each checked; empty tables give empty results or no matches; other columns pass through untouched.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import parts, text_or_empty
from .hashing import SIGNS, text_shingles

RADIUS = 20
SIMILARITY = 0.8
SLICE_BYTES = 4 << 20
BLOCKS = 8
WINDOWS = 20_000  # hashed at once; windows times items of one size are bounded as well
CELLS = 8 << 20
SPAN = 1 << 16  # shingles over which sums are held


def simhash(sums: np.ndarray) -> np.ndarray:
    """Fingerprints from the sums of +1 and -1 over 64 bit positions."""
    return np.packbits(sums > 0, axis=-1, bitorder="little").view(np.uint64).ravel()


def signs(hashes: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.astype(np.int32) * 2 - 1


def near_table(values: np.ndarray, radius: int) -> np.ndarray:
    """For each value of a block of 8 bits, a packed mask of the items whose block lies within the radius."""
    every = np.arange(256, dtype=np.uint8)
    return np.packbits(np.bitwise_count(every[:, None] ^ values[None, :]) <= radius, axis=1)


class Items:
    """The benchmark items of one slice, ready for matching."""

    def __init__(self, ids: list, texts: list[str], radius: int = RADIUS, least: float = SIMILARITY):
        hashes, firsts = text_shingles(texts, between=SIGNS)
        kept = np.flatnonzero(np.diff(firsts))
        self.ids = [ids[i] for i in kept]
        self.sets = [np.unique(hashes[firsts[i] : firsts[i + 1]], return_counts=True) for i in kept]
        self.sizes = np.array([firsts[i + 1] - firsts[i] for i in kept], np.int64)
        self.prints = np.array([simhash(signs(hashes[firsts[i] : firsts[i + 1]]).sum(0))[0] for i in kept], np.uint64)
        owner = np.repeat(np.arange(len(kept)), [len(s[0]) for s in self.sets])
        flat = np.concatenate([s[0] for s in self.sets]) if self.sets else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.flat, self.owner = flat[order], owner[order]
        self.seen = np.zeros(1 << 20, bool)
        self.seen[flat & np.uint64((1 << 20) - 1)] = True
        self.radius, self.least, self.tables = radius, least, {}

    def candidates(self, prints: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) of the fingerprints within the radius of an item of this size, found through the tables."""
        blocks = lambda x: x.view(np.uint8).reshape(-1, BLOCKS)
        if size not in self.tables:
            who = np.flatnonzero(self.sizes == size)
            self.tables[size] = who, [near_table(blocks(self.prints[who])[:, b], self.radius // BLOCKS) for b in range(BLOCKS)]
        who, tables = self.tables[size]
        mask = np.zeros((len(prints), tables[0].shape[1]), np.uint8)
        for b in range(BLOCKS):
            mask |= tables[b][blocks(prints)[:, b]]
        window, item = np.nonzero(np.unpackbits(mask, axis=1, count=len(who)))
        close = np.bitwise_count(prints[window] ^ self.prints[who[item]]) <= self.radius
        return window[close], who[item[close]]

    def similarity(self, window: np.ndarray, item: int) -> float:
        values, counts = np.unique(window, return_counts=True)
        _, a, b = np.intersect1d(values, self.sets[item][0], assume_unique=True, return_indices=True)
        both = np.minimum(counts[a], self.sets[item][1][b]).sum()
        return float(both) / float(len(window) + self.sizes[item] - both)

    def match(self, hashes: np.ndarray) -> dict[int, float]:
        """The items that one text holds, with the similarity of the best window."""
        n, best = len(hashes), {}
        maybe = np.flatnonzero(self.seen[hashes & np.uint64((1 << 20) - 1)])
        low, high = np.searchsorted(self.flat, hashes[maybe]), np.searchsorted(self.flat, hashes[maybe], "right")
        maybe, low, high = maybe[high > low], low[high > low], high[high > low]
        if not len(maybe):
            return best
        at = np.repeat(maybe, high - low)
        items = np.concatenate([self.owner[a:b] for a, b in zip(low, high, strict=True)])
        for size in np.unique(self.sizes[items]):
            shared = np.unique(at[self.sizes[items] == size])
            width = min(int(size), n)
            opened = np.zeros(n + 1, np.int64)
            np.add.at(opened, np.maximum(shared - width + 1, 0), 1)
            np.add.at(opened, np.minimum(shared, n - width) + 1, -1)
            starts = np.flatnonzero(np.cumsum(opened)[: n - width + 1])
            most = max(1, min(WINDOWS, CELLS // int((self.sizes == size).sum())))
            spans = np.split(starts, np.flatnonzero(np.diff(starts // SPAN)) + 1)
            for part in [p for span in spans for p in np.array_split(span, -(-len(span) // most))]:
                lo, hi = part[0], part[-1] + width
                sums = np.zeros((hi - lo + 1, 64), np.int32)
                np.cumsum(signs(hashes[lo:hi]), axis=0, out=sums[1:])
                window, item = self.candidates(simhash(sums[part - lo + width] - sums[part - lo]), int(size))
                for w, i in zip(part[window].tolist(), item.tolist(), strict=True):
                    if (s := self.similarity(hashes[w : w + width], i)) >= self.least and s > best.get(i, 0.0):
                        best[i] = s
        return {self.ids[i]: s for i, s in sorted(best.items())}

    def match_all(self, texts: list[str | None]) -> list[dict[int, float]]:
        hashes, firsts = text_shingles([t or "" for t in texts], between=SIGNS)
        hit = np.concatenate([[0], np.cumsum(self.seen[hashes & np.uint64((1 << 20) - 1)])])
        some = hit[firsts[1:]] > hit[firsts[:-1]]
        return [self.match(hashes[firsts[k] : firsts[k + 1]]) if some[k] else {} for k in range(len(texts))]


def slices(benchmark: DataFrame, slice_bytes: int = SLICE_BYTES) -> list[list[tuple[int, str]]]:
    """The items in slices whose text is bounded; one slice at a time comes to the driver."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_or_empty().alias("text"))
    total = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = max(1, math.ceil(1.5 * total / slice_bytes)) if total > slice_bytes else 1
    for k in range(n):
        yield [tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()]


def find_items(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """One row per document: doc_id, contaminated, item_ids, similarities (of the best window of each item)."""
    empty = lambda kind: F.lit(None).cast(f"array<{kind}>")
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), empty("long").alias("item_ids"), empty("double").alias("similarities"))
    schema = "doc_id long, text string, item_ids array<long>, similarities array<double>"
    for part in slices(benchmark):

        def work(batches, part=part):
            items = Items([i for i, _ in part], [t for _, t in part], radius, least)
            for batch in parts(batches, 1, 512):
                got = [list(m.items()) for m in items.match_all(batch.column(1).to_pylist())]
                ids = [(a or []) + [i for i, _ in m] for a, m in zip(batch.column(2).to_pylist(), got, strict=True)]
                sims = [(a or []) + [s for _, s in m] for a, m in zip(batch.column(3).to_pylist(), got, strict=True)]
                columns = [batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int64())), pa.array(sims, pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text", "item_ids", "similarities"])

        found = found.mapInArrow(work, schema)
    return found.select("doc_id", (F.size("item_ids") > 0).alias("contaminated"), "item_ids", "similarities")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs``, all columns, in which no item is found."""
    at = docs.columns.index("text")
    for part in slices(benchmark):

        def work(batches, part=part):
            items = Items([i for i, _ in part], [t for _, t in part], radius, least)
            for batch in parts(batches, at, 512):
                yield batch.filter(pa.array([not m for m in items.match_all(batch.column(at).to_pylist())], pa.bool_()))

        docs = docs.mapInArrow(work, T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema.fields]))
    return docs
