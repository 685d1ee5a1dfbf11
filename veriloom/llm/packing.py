"""Packing documents into windows of a fixed number of tokens by best-fit decreasing.

A document longer than a window is first cut into full windows and a rest. Best-fit decreasing places pieces from
the largest down, each into the open window with the least room that still holds it. The placement depends on
the pieces' sizes alone, so it is computed on the histogram of sizes: at most ``capacity`` counts, whatever the
corpus. A segment tree over remaining capacity finds the tightest open window; windows of the same content are
placed in bulk, which gives exactly the windows that placing piece by piece gives. The resulting plan names, for
each size, ranges of pieces by their rank within that size, and is joined back to the pieces.

Defined cases: null text counts as empty and packs as the closing id alone; repeated rows are packed each; a null
doc_id stays null; an empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

import re
import struct
import sys
import types
import unicodedata
import zlib
from bisect import bisect_left
from collections import ChainMap

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, parts, text_or_empty

CAPACITY = 2048
END_ID = 1
CACHED_WORDS = 1_000_000

# Fixed value: the word pattern of the tokenizer file, for texts below U+0300.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_²³¹¼½¾]+|[\d²³¹¼½¾]|(?:_|[^\w\s])+"


def word_pattern() -> re.Pattern:
    """The same pattern with its classes written out, letters first, for lower-cased texts of characters below U+0300."""
    known = sorted({c for k in range(0x300) for c in chr(k).lower()} | set(map(chr, range(0x300))))
    letters, digits, signs = ("".join(re.escape(c) for c in known if re.fullmatch(kind, c)) for kind in (r"[^\W\d_²³¹¼½¾]", r"[\d²³¹¼½¾]", r"_|[^\w\s]"))
    return re.compile(rf"[{letters}]+|'(?:s|t|re|ve|m|ll|d)|[{digits}]|[{signs}]+")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level file: itself if printable, else the next from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class WordEncoder:
    """Token ids of a word-level BPE file as little-endian bytes, word by word through a bounded cache.

    In such a file a word's ids do not depend on its neighbours. Texts on which Python's lower-casing, white space,
    letters or normal form could differ from the file's own go to the tokenizer whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.find = word_pattern().findall
        self.odd = re.compile("[^\x00-˿]|[\x1c-\x1f\x85\xa0İŉǰ]").search
        self.control = re.compile("[\x1c-\x1f]").search
        self.words: dict[str, bytes] = {}

    def _ids(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        if not (word.isascii() and word.isprintable()):
            word = "".join([self.letters[b] for b in word.encode()])
        ids = [x.id for x in self.model.tokenize(word)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def many(self, texts: list[str]) -> list[bytes]:
        """The ids of each text. A full cache takes no more words; those of one call are kept aside for it."""
        known = self.words
        found = [self.find(x.lower()) if x.isascii() and not self.control(x) else None if self.odd(x) or not unicodedata.is_normalized("NFC", x) else self.find(x.lower()) for x in texts]
        missing = set().union(*[words for words in found if words]).difference(known)
        if missing:
            new = {w: self._word(w) for w in missing}
            if len(known) + len(new) <= CACHED_WORDS:
                known.update(new)
            else:
                known = ChainMap(new, known)
        return [self._ids(x) if words is None else b"".join(map(known.__getitem__, words)) for x, words in zip(texts, found, strict=True)]

    def __call__(self, text: str) -> bytes:
        return self.many([text])[0]


def encoder(path: str) -> WordEncoder:
    """One encoder for each Python worker and file."""
    kept = sys.modules.setdefault("_veriloom_encoders", types.ModuleType("_veriloom_encoders")).__dict__
    if path not in kept:
        kept[path] = WordEncoder(path)
    return kept[path]


PIECES = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long, part int, nth long"


def cut(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The pieces of every document, each with its number among the pieces of its length in its partition."""

    def work(batches):
        from pyspark import TaskContext

        encode, part, seen = encoder(path), TaskContext.get().partitionId(), {}
        end, types = np.uint32(end_id).astype("<u4").tobytes(), [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
        for batch in parts(batches, 1, 200):
            rows = []
            for doc, ids in zip(batch.column(0).to_pylist(), encode.many(batch.column(1).to_pylist()), strict=True):
                ids += end
                n = len(ids) // 4
                for start in range(0, n, capacity):
                    length = min(capacity, n - start)
                    nth = seen[length] = seen.get(length, -1) + 1
                    rows.append((doc, start, length, zlib.crc32(memoryview(ids)[4 * start : 4 * (start + length)]), n, part, nth))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "nth"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(work, PIECES)


class RoomTree:
    """Segment tree over remaining capacities: the least one of at least s that some open window has."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.any = [False] * (2 * self.leaves)

    def set(self, room: int, present: bool) -> None:
        node = room + self.leaves
        self.any[node] = present
        while node := node >> 1:
            self.any[node] = self.any[2 * node] or self.any[2 * node + 1]

    def tightest(self, least: int) -> int | None:
        node = least + self.leaves
        if self.any[node]:
            return least
        while node > 1:
            if node % 2 == 0 and self.any[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.any[2 * node] else 2 * node + 1
                return node - self.leaves
            node >>= 1
        return None


def best_fit_decreasing(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """The plan for ``counts`` pieces of each size: (size, rank_from, rank_to, window, per_window, offset).

    Pieces of ``size`` with rank r in [rank_from, rank_to) lie in window ``window + (r - rank_from) // per_window``
    at ``offset + size * ((r - rank_from) % per_window)``. Open windows are runs of neighbouring window numbers
    with the same room; the run with the smallest number goes first.
    """
    plan, tree, runs, opened = [], RoomTree(capacity), {}, 0

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            have = runs.setdefault(room, [])
            have.insert(bisect_left(have, (first, n)), (first, n))
            tree.set(room, True)

    for size in sorted(counts, reverse=True):
        rank, left = 0, counts[size]
        while left:
            room = tree.tightest(size)
            if room is None:
                each = capacity // size
                room, first, n = capacity, opened, -(-left // each)
                opened += n
            else:
                first, n = runs[room].pop(0)
                if not runs[room]:
                    tree.set(room, False)
            each = room // size
            placed = min(left, n * each)
            full, rest = divmod(placed, each)
            plan.append((size, rank, rank + placed, first, each, capacity - room))
            put(room - each * size, first, full)
            if rest:
                put(room - rest * size, first + full, 1)
            put(room, first + full + bool(rest), n - full - bool(rest))
            rank, left = rank + placed, left - placed
    return plan


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens.

    A sequence is padded to ``capacity`` unless its tokens are a power of two; ``padded_to`` says to what length.
    """
    spark = docs.sparkSession
    pieces = materialize(cut(docs, path, capacity, end_id), "pieces")
    by_part = materialize(pieces.groupBy("length", "part").count(), "piece-counts")
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    plan = best_fit_decreasing(counts, capacity)
    names = "size int, rank_from long, rank_to long, window long, per_window int, offset0 int"
    bounds = F.broadcast(spark.createDataFrame(plan, names))  # a few entries for each size up to the capacity
    before = F.sum("count").over(Window_by_length())
    bases = by_part.select("length", "part", (before - F.col("count")).alias("base"))
    # the bases grow with the partitions, so they are never broadcast
    ranked = pieces.join(bases.hint("merge"), ["length", "part"]).withColumn("rank", F.col("base") + F.col("nth"))
    at = F.col("rank") - F.col("rank_from")
    placed = ranked.join(bounds, (F.col("length") == F.col("size")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to")))
    return placed.select(
        "doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens",
        (F.col("window") + F.floor(at / F.col("per_window"))).cast("long").alias("sequence_id"),
        (F.col("offset0") + F.col("size") * F.pmod(at, F.col("per_window"))).cast("long").alias("offset"),
    )


def Window_by_length():
    """Running counts over the partitions that wrote pieces of one length: a row for each such partition."""
    from pyspark.sql import Window

    return Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
