"""Removal of long byte strings that occur more than once, by blockwise suffix sorting with difference covers.

Two suffixes tie over ``length`` bytes exactly if those strings are equal. A difference cover D of period v has, for
any two positions, a shift d < v that takes both to residues in D. That serves twice:

1. The samples, positions with residues of a large cover, are told apart by fingerprints of ``length - v + 1`` bytes.
   A suffix none of whose samples is found elsewhere cannot tie with any other; only the rest stay open.
2. Open suffixes go to buckets, one bucket is sorted at a time. A suffix's bucket hangs on its own first ``length``
   bytes alone (by the least hash among their 16-grams), so suffixes that tie share a bucket, and successive suffixes
   mostly share one too: they travel as one piece of text. In a bucket, suffixes with a fingerprint of their own are
   left out; of the rest, a small cover's sample gets its ranks first, in the order of the bytes, by prefix doubling.
   Then suffixes are sorted by their first and last bytes, and the long ties between them are decided by the sample's
   ranks at the shift that both have in common. Nothing is compared further than its ``length`` bytes, and memory
   holds one bucket.

Step 2 compares bytes, so what it removes is repeated for certain. A bucket's key that more than ``HOT`` pieces share
(a passage in very many texts, each with other neighbours) is not sorted in one task: its suffixes are compared by
64-bit fingerprints of their ``length`` bytes instead, whose ranges split it among tasks.

Texts that are equal as a whole are one text with a count (grouped with partial aggregates, so a hot group of copies
travels once a task). Each task sends a value or a piece that it holds many times once, so a passage that many texts
share costs one value a chunk. Intermediate tables go to the shared folder.

Beside the bytes that go, texts are told that hold a run of ``words`` words which another text has as well, whatever
its length in bytes: a cover over the places of words leaves runs open, whose fingerprints are then compared. Words
are runs of letters, digits and non-ASCII characters, letters A to Z in lower case; nothing is removed for them.

Defined cases: null is the empty text; texts under ``length`` bytes lose nothing; equal texts of at least ``length``
bytes lose everything, each of them; overlapping occurrences within one text count; repeated rows are copies; an
empty table gives no rows; other columns of the input are not read. A text is never split: a task needs about 50
times the bytes of the longest one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_shuffles, join_groups, materialize, text_or_empty
from .hashing import SIGNS, U, Prefix, joined, mix, words

LENGTH = 400
ORDER = 13  # of the cover whose samples leave suffixes open: 14 residues of 183
CHUNK_BYTES = 4 << 20
BUCKET_BYTES = 1 << 20
GRAM = 16
HOT = 1000  # pieces with the same key of a bucket
WORDS, WORD_ORDER = 50, 5
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def difference_cover(q: int) -> tuple[int, np.ndarray]:
    """Period q^2+q+1 and a cover of q+1 residues, for a prime q: the powers of a generator of the cubic
    extension of GF(q) that lie in a plane; every residue is a difference of two of them."""
    period = q * q + q + 1
    for code in range(q**3):
        a, b, c = code // (q * q), code // q % q, code % q
        power, cover = (1, 0, 0), []
        for k in range(period):
            if power[2] == 0:
                cover.append(k)
            low, mid, high = power
            power = (high * c % q, (low + high * b) % q, (mid + high * a) % q)
        if len(cover) == q + 1 and len({(x - y) % period for x in cover for y in cover}) == period:
            return period, np.array(cover, np.int64)
    raise ValueError("q must be a prime")


class Sorter:
    """What the steps share on executors: the cover, and how a chunk's values are cut into buckets."""

    def __init__(self, length: int, order: int, bucket_bits: int):
        self.length, self.bits = length, bucket_bits
        self.period, cover = difference_cover(order)
        self.rest = length - self.period + 1
        if self.rest < 16:
            raise ValueError("the length must exceed the cover's period by 16 at least")
        self.cover = np.sort(cover)

    def open(self, blob: bytes, lengths: bytes) -> None:
        import zstandard

        sizes = np.frombuffer(lengths, np.int64)
        self.bounds = np.concatenate([[0], np.cumsum(sizes)])
        self.data = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob, max_output_size=int(self.bounds[-1])), np.uint8)
        self.one = Prefix(self.data)

    def values(self, at: np.ndarray, length: int) -> np.ndarray:
        return mix(self.one.hashes(at, at + length))

    def samples(self) -> np.ndarray:
        """The cover sample: places with enough text behind them to take part in a tie."""
        start, sizes = self.bounds[:-1], np.diff(self.bounds)
        turns = np.arange(int(sizes.max(initial=0)) // self.period + 1) * self.period
        pattern = (turns[:, None] + self.cover).ravel()
        counts = np.searchsorted(pattern, sizes - self.rest, side="right")
        done = np.cumsum(counts) - counts
        return np.repeat(start, counts) + pattern[np.arange(counts.sum()) - np.repeat(done, counts)]

    def unresolved(self, samples: np.ndarray, shared: np.ndarray) -> np.ndarray:
        """The suffixes that the ranks leave open: a sample whose rank is shared lies less than a period behind."""
        hit, size, start, end = samples[shared], int(self.bounds[-1]), self.bounds[:-1], self.bounds[1:]
        opened = np.zeros(size + 1, np.int32)
        np.add.at(opened, np.maximum(hit - self.period + 1, start[np.searchsorted(start, hit, side="right") - 1]), 1)
        np.add.at(opened, hit + 1, -1)
        np.add.at(opened, np.maximum(start, end - self.length + 1), -(1 << 20))  # too little text behind
        np.add.at(opened, end, 1 << 20)
        return np.flatnonzero(np.cumsum(opened[:-1]) > 0)

    def pieces(self, at: np.ndarray):
        """Runs of successive open suffixes with the same bucket key, each distinct text once.

        Gives for each piece its key, the number of suffixes, the starts of its occurrences, and its bytes.
        """
        if not len(at):
            return
        width = self.length - GRAM + 1
        near = np.zeros(len(self.data) + 1, np.int32)  # only grams of open suffixes are hashed
        near[at] += 1
        near[at + width] -= 1
        place = np.flatnonzero(np.cumsum(near[:-1]) > 0)
        with np.errstate(over="ignore"):
            grams = mix(self.one.hashes(place, place + GRAM))
        low = (grams & U(0xFFFFFFFF00000000)) | np.arange(len(place), dtype=U)  # equal hashes: the first one of the window
        span, begin = 1, np.searchsorted(place, at)
        while 2 * span <= width:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        anchor = (np.minimum(low[begin], low[begin + width - span]) & U(0xFFFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (np.diff(anchor) != 0)]))
        start, n = at[first], np.diff(np.append(first, len(at)))
        end = start + n - 1 + self.length
        found: dict[bytes, list[int]] = {}
        for k, (a, b) in enumerate(zip(start.tolist(), end.tolist(), strict=True)):
            found.setdefault(self.data[a:b].tobytes(), []).append(k)
        keys = grams[anchor[first]].view(np.int64)
        for text, where in found.items():
            yield int(keys[where[0]]), int(n[where[0]]), start[where], text

    def ship(self, values: np.ndarray, step: int, chunk: int, owners: np.ndarray | None = None):
        """A row for each range of values: the chunk's distinct ones in order, and which of them it holds repeatedly.

        With ``owners``, a value is held repeatedly only where two of them have it.
        """
        if owners is not None and len(values):
            order = np.lexsort((owners, values))
            values, owners = values[order], owners[order]
            values = values[np.concatenate([[True], (values[1:] != values[:-1]) | (owners[1:] != owners[:-1])])]
        distinct, counts = np.unique(values, return_counts=True)
        edges = np.searchsorted(distinct, (np.arange(1, 1 << self.bits, dtype=U) << U(64 - self.bits)) if self.bits else np.zeros(0, U))
        edges = np.concatenate([[0], edges, [len(distinct)]])
        for bucket in np.flatnonzero(np.diff(edges)).tolist():
            part = slice(edges[bucket], edges[bucket + 1])
            yield bucket, chunk, step, distinct[part].tobytes(), np.packbits(counts[part] > 1).tobytes()

    def shared(self, values: np.ndarray, flags: dict[int, bytes]) -> np.ndarray:
        """For each value whether another position has it, from the ranges' answers."""
        distinct, inverse = np.unique(values, return_inverse=True)
        edges = np.searchsorted(distinct, (np.arange(1, 1 << self.bits, dtype=U) << U(64 - self.bits)) if self.bits else np.zeros(0, U))
        edges = np.concatenate([[0], edges, [len(distinct)]])
        out = np.zeros(len(distinct), bool)
        for bucket, bits in flags.items():
            n = edges[bucket + 1] - edges[bucket]
            out[edges[bucket] : edges[bucket + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=int(n))
        return out[inverse]


class WordSorter(Sorter):
    """The same over the words of a chunk's texts: places and lengths count words."""

    def open(self, blob: bytes, lengths: bytes) -> None:
        import zstandard

        sizes = np.frombuffer(lengths, np.int64)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        data = LOWER[np.frombuffer(zstandard.ZstdDecompressor().decompress(blob, max_output_size=int(bounds[-1])), np.uint8)]
        starts, ends, firsts = words(data, bounds, SIGNS)
        solid = ~SIGNS[data]
        kept = solid.copy()
        kept[1:] |= solid[:-1]  # one sign after each word
        place = np.concatenate([[0], np.cumsum(kept)])
        data = np.where(solid, data, 32).astype(np.uint8)[kept]
        self.at, self.to, self.bounds = place[starts], place[ends - 1] + 1, firsts
        self.owner = np.repeat(np.arange(len(sizes)), np.diff(firsts))
        self.one = Prefix(data)

    def values(self, at: np.ndarray, length: int) -> np.ndarray:
        return mix(self.one.hashes(self.at[at], self.to[at + length - 1]))


SHIPPED = "bucket int, chunk long, step int, hashes binary, often binary"
ANSWER = "bucket int, chunk long, step int, bits binary"
PIECES = "anchor long, chunk long, n int, starts binary, text binary"


def _rows(rows, schema: str):
    names = [part.split()[0] for part in schema.split(", ")]
    kinds = [{"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[part.split()[1]] for part in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def sort_buckets(shipped: DataFrame) -> DataFrame:
    """Sort each range of fingerprints and tell every chunk which of its values occur elsewhere too."""

    def one(key, table):
        parts = [np.frombuffer(b.as_py(), U) for b in table.column("hashes")]
        sizes = np.array([len(p) for p in parts])
        values = np.concatenate(parts)
        often = np.concatenate([np.unpackbits(np.frombuffer(b.as_py(), np.uint8), count=int(n)) for b, n in zip(table.column("often"), sizes, strict=True)]).astype(bool)
        order = np.argsort(values, kind="stable")
        ranked = values[order]
        same = ranked[1:] == ranked[:-1]
        tied = np.zeros(len(values), bool)
        tied[1:] |= same
        tied[:-1] |= same
        often[order] |= tied
        rows, last = [], 0
        for chunk, step, n in zip(table.column("chunk").to_pylist(), table.column("step").to_pylist(), sizes.tolist(), strict=True):
            if often[last : last + n].any():
                rows.append((key[0].as_py(), chunk, step, np.packbits(often[last : last + n]).tobytes()))
            last += n
        return pa.Table.from_batches([_rows(rows, ANSWER)]) if rows else pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("step", pa.int32()), ("bits", pa.binary())]).empty_table()

    return shipped.groupBy("bucket").applyInArrow(one, ANSWER)


def dense(x: np.ndarray) -> np.ndarray:
    """Ranks from 0 in the order of the values, equal ones alike."""
    order = np.argsort(x)
    ordered, step = x[order], np.zeros(len(x), U)
    step[1:] = ordered[1:] != ordered[:-1]
    out = np.empty(len(x), U)
    out[order] = np.cumsum(step, dtype=U)
    return out


def tied_suffixes(data: np.ndarray, bounds: np.ndarray, counts: np.ndarray, length: int) -> np.ndarray:
    """Which of the first ``counts[k]`` suffixes of each piece tie with another over ``length`` bytes; one flag each.

    Piece k is data[bounds[k]:bounds[k + 1]], with ``length`` bytes behind the start of each of those suffixes.
    """
    period, cover = difference_cover(5 if length >= 124 else 3)
    in_cover, sizes, m = np.zeros(period, bool), np.diff(bounds), len(data)
    in_cover[cover] = True
    place = np.arange(m) - np.repeat(bounds[:-1], sizes)
    room, residue, scale = np.repeat(bounds[1:], sizes) - np.arange(m), place % period, U(m + 1)

    def after(x: np.ndarray, k: int) -> np.ndarray:
        return np.concatenate([x[k:], np.zeros(min(k, m), U)])

    # the order of the first ``period`` bytes at every position
    padded, head = np.concatenate([data, np.zeros(8, np.uint8)]), np.zeros(m, U)
    for k in range(8):
        head = head << U(8) | padded[k : k + m].astype(U)
    head, known = dense(head), 8
    while known < period:
        step = min(known, period - known)
        head, known = dense(head * scale + after(head, step)), known + step
    # the order of ``whole`` bytes at the sample, by doubling over its period
    times = (length - period + 1) // period
    whole, sampled = period * times, in_cover[residue]
    levels = [head]
    while 2 << (len(levels) - 1) <= times:
        step = period << (len(levels) - 1)
        p = np.flatnonzero(sampled & (room >= 2 * step))
        level = np.zeros(m, U)
        level[p] = dense(levels[-1][p] * scale + levels[-1][p + step])
        levels.append(level)
    p = np.flatnonzero(sampled & (room >= whole))
    rank, done = None, 0
    for t in reversed(range(len(levels))):
        if times >> t & 1:
            rank = levels[t][p] if rank is None else dense(rank * scale + levels[t][p + done])
            done += period << t
    ranks = np.zeros(m, U)
    ranks[p] = rank
    # suffixes by their first and last bytes, then by the ranks at each shift
    at = np.flatnonzero(place < np.repeat(counts, sizes))
    ends, tied = head[at], np.zeros(len(at), bool)
    for t in range(length - period, whole - period, -period):
        ends = dense(ends * scale + head[at + t])
    live = np.flatnonzero(np.bincount(ends.astype(np.int64))[ends.astype(np.int64)] > 1) if len(at) else np.zeros(0, np.int64)
    at, ends, found = at[live], dense(ends[live]).astype(np.int64), np.zeros(len(live), bool)
    for d in range(period):
        undecided = np.bincount(ends, weights=~found) > 0 if len(at) else found
        some = np.flatnonzero(in_cover[(residue[at] + d) % period] & undecided[ends])
        key = ends[some].astype(U) * scale + ranks[at[some] + d]
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        found[some[order[1:]]] |= same
        found[some[order[:-1]]] |= same
    tied[live] = found
    return tied


def tied_in_bucket(texts: list[bytes], counts: np.ndarray, length: int) -> np.ndarray:
    """The flags of all pieces' suffixes. What has a fingerprint of its own cannot tie and is not sorted."""
    data, bounds = joined(texts)
    edges = np.concatenate([[0], np.cumsum(counts)])
    at = np.arange(edges[-1]) + np.repeat(bounds[:-1] - edges[:-1], counts)
    values = mix(Prefix(data).hashes(at, at + length))
    order = np.argsort(values)
    same, shared = np.diff(values[order]) == 0, np.zeros(len(at), bool)
    shared[order[1:]] |= same
    shared[order[:-1]] |= same
    out, live = np.zeros(len(at), bool), np.flatnonzero(shared)
    if not len(live):
        return out
    owner = np.searchsorted(edges, live, side="right") - 1
    first = np.flatnonzero(np.concatenate([[True], np.diff(owner) != 0]))
    last = np.append(first[1:], len(live)) - 1
    lo, hi, piece = live[first], live[last] + 1, owner[first]
    start, n = bounds[piece] + lo - edges[piece], hi - lo
    cuts = [data[a:b] for a, b in zip(start.tolist(), (start + n - 1 + length).tolist(), strict=True)]
    ends = np.concatenate([[0], np.cumsum(n - 1 + length)])
    tied, done = tied_suffixes(np.concatenate(cuts), ends, n, length), np.concatenate([[0], np.cumsum(n)])
    out[np.arange(done[-1]) + np.repeat(lo - done[:-1], n)] = tied
    return out


TIED = "chunk long, starts binary, bits binary"


def sort_pieces(pieces: DataFrame, length: int) -> DataFrame:
    """Sort the suffixes of each bucket; chunk, starts of the occurrences and flags of pieces with tied suffixes."""

    def one(key, table):
        texts = table.column("text").to_pylist()
        counts, starts = table.column("n").to_numpy().astype(np.int64), table.column("starts").to_pylist()
        tied = tied_in_bucket(texts, counts, length)
        edges, rows = np.concatenate([[0], np.cumsum(counts)]).tolist(), []
        for k, (chunk, where) in enumerate(zip(table.column("chunk").to_pylist(), starts, strict=True)):
            flags = tied[edges[k] : edges[k + 1]] if len(where) == 8 else np.ones(counts[k], bool)
            if flags.any():
                rows.append((chunk, where, np.packbits(flags).tobytes()))
        return pa.Table.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.binary(), pa.binary()))], names=["chunk", "starts", "bits"])

    return pieces.groupBy("bucket").applyInArrow(one, TIED)


def compare_prints(pieces: DataFrame, length: int) -> DataFrame:
    """The same for pieces whose key is hot: suffixes meet by fingerprints, in ranges that split any key among tasks."""
    total = pieces.agg(F.sum("n")).first()[0] or 0
    sorter = Sorter(length, ORDER if length > 199 else 5, max(0, int(np.ceil(np.log2(max(1, total * 8 / (32 << 20)))))))

    def prints(table):
        texts, counts = table.column("text").to_pylist(), table.column("n").to_numpy().astype(np.int64)
        data, bounds = joined(texts)
        at = np.concatenate([np.arange(a, a + n) for a, n in zip(bounds[:-1].tolist(), counts.tolist(), strict=True)])
        with np.errstate(over="ignore"):
            values = mix(mix(Prefix(data).hashes(at, at + length)) * U(3) + Prefix(data, 2, 0x9FB21C651E98DF25).hashes(at, at + length))
        often = np.repeat([len(s) > 8 for s in table.column("starts").to_pylist()], counts)
        return values, often, counts

    def ship(key, table):
        values, often, _ = prints(table)
        values = np.concatenate([values, values[often]])
        return pa.Table.from_batches([_rows(list(sorter.ship(values, 1, key[0].as_py())), SHIPPED)])

    def resolve(key, table, answers):
        if not table.num_rows:
            return pa.schema([("chunk", pa.int64()), ("starts", pa.binary()), ("bits", pa.binary())]).empty_table()
        values, _, counts = prints(table)
        flags = sorter.shared(values, dict(zip(answers.column("bucket").to_pylist(), answers.column("bits").to_pylist(), strict=True)))
        edges, rows = np.concatenate([[0], np.cumsum(counts)]).tolist(), []
        for k, (chunk, where) in enumerate(zip(table.column("chunk").to_pylist(), table.column("starts").to_pylist(), strict=True)):
            if (mine := flags[edges[k] : edges[k + 1]]).any():
                rows.append((chunk, where, np.packbits(mine).tobytes()))
        return pa.Table.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.binary(), pa.binary()))], names=["chunk", "starts", "bits"])

    answers = materialize(sort_buckets(pieces.groupBy("chunk").applyInArrow(ship, SHIPPED)), "hot-ties")
    return pieces.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(resolve, TIED)


def distinct_texts(docs: DataFrame, length: int) -> DataFrame:
    """digest, bytes, copies of every distinct text that is long enough."""
    rows = docs.select(F.encode(text_or_empty(), "utf-8").alias("bytes")).where(F.octet_length("bytes") >= length)
    return rows.withColumn("digest", F.unhex(F.sha2("bytes", 256))).groupBy("digest").agg(F.first("bytes").alias("bytes"), F.count("*").alias("copies"))


def pack_chunks(texts: DataFrame, chunk_bytes: int) -> DataFrame:
    """Whole texts in compressed chunks, each a row."""

    def work(batches):
        import zstandard
        from pyspark import TaskContext

        pack, chunk, held, size = zstandard.ZstdCompressor(level=1), TaskContext.get().partitionId() << 32, [], 0

        def close():
            lengths = np.array([len(t) for _, t, _ in held], np.int64)
            row = (chunk, pack.compress(b"".join([t for _, t, _ in held])), lengths.tobytes(), b"".join([d for d, _, _ in held]), np.array([c for _, _, c in held], np.int64).tobytes(), int(lengths.sum()))
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, [pa.int64(), *[pa.binary()] * 4, pa.int64()], strict=True)], names=["chunk", "blob", "lengths", "digests", "copies", "size"])

        for batch in batches:
            for digest, text, copies in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                held.append((digest.as_py(), text.as_py(), copies.as_py()))
                size += len(held[-1][1])
                if size >= chunk_bytes:
                    yield close()
                    chunk, held, size = chunk + 1, [], 0
        if held:
            yield close()

    return texts.mapInArrow(work, "chunk long, blob binary, lengths binary, digests binary, copies binary, size long")


def range_bits(total: float, order: int) -> int:
    """Bits of a fingerprint that name its range, for a cover's samples of so many places."""
    shipped = total * (order + 1) / (order * order + order + 1) * 8
    return max(0, int(np.ceil(np.log2(max(1.0, shipped / min(max(2 << 20, shipped / 2000), 64 << 20))))))


def with_answers(chunks: DataFrame, answers: DataFrame, *columns: str) -> DataFrame:
    """Each chunk with what the buckets answered it."""
    by_chunk = answers.groupBy("chunk").agg(F.collect_list(F.struct(*columns)).alias("flags"))
    return chunks.join(by_chunk, "chunk", "left")


def shared_words(chunks: DataFrame, total: int, count: int, order: int = WORD_ORDER) -> DataFrame:
    """chunk, words: for each of a chunk's texts, its words that lie in runs of ``count`` words of another text too."""
    spark = chunks.sparkSession
    sorter = WordSorter(count, order, range_bits(total / 6, order))

    def rank_samples(batches):
        for batch in batches:
            for row in batch.to_pylist():
                sorter.open(row["blob"], row["lengths"])
                at = sorter.samples()
                if rows := list(sorter.ship(sorter.values(at, sorter.rest), 0, row["chunk"], sorter.owner[at])):
                    yield _rows(rows, SHIPPED)

    def left_open(row):
        sorter.open(row["blob"], row["lengths"])
        flags = {0: {}, 1: {}}
        for f in row["flags"] or []:
            flags[f["step"]][f["bucket"]] = f["bits"]
        samples = sorter.samples()
        return (sorter.unresolved(samples, sorter.shared(sorter.values(samples, sorter.rest), flags[0])) if flags[0] else samples[:0]), flags[1]

    def ship_runs(batches):
        for batch in batches:
            for row in batch.to_pylist():
                at, _ = left_open(row)
                if rows := list(sorter.ship(sorter.values(at, count), 1, row["chunk"], sorter.owner[at])):
                    yield _rows(rows, SHIPPED)

    def tell(batches):
        for batch in batches:
            for row in batch.to_pylist():
                at, flags = left_open(row)
                if len(at) and flags:
                    tied, edge = at[sorter.shared(sorter.values(at, count), flags)], np.zeros(len(sorter.owner) + 1, np.int32)
                    np.add.at(edge, tied, 1)
                    np.add.at(edge, tied + count, -1)
                    held = np.bincount(sorter.owner, weights=np.cumsum(edge[:-1]) > 0, minlength=len(sorter.bounds) - 1).astype(np.int64)
                    if held.any():
                        yield pa.RecordBatch.from_arrays([pa.array([row["chunk"]], pa.int64()), pa.array([held.tobytes()], pa.binary())], names=["chunk", "words"])

    blobs = chunks.select("chunk", "blob", "lengths")
    ranks = materialize(sort_buckets(blobs.mapInArrow(rank_samples, SHIPPED)), "word-samples")
    drop_shuffles(spark)
    runs = materialize(sort_buckets(with_answers(blobs, ranks, "step", "bucket", "bits").select("chunk", "blob", "lengths", "flags").mapInArrow(ship_runs, SHIPPED)), "word-runs")
    drop_shuffles(spark)
    told = with_answers(blobs, ranks.unionByName(runs), "step", "bucket", "bits").select("chunk", "blob", "lengths", "flags")
    told = materialize(told.mapInArrow(tell, "chunk long, words binary"), "words")
    drop_shuffles(spark)
    return told


def repeats(docs: DataFrame, length: int = LENGTH, order: int = ORDER, chunk_bytes: int = CHUNK_BYTES, count: int = WORDS) -> DataFrame:
    """One row for each distinct text that loses bytes or shares a run of words: digest, copies, n_removed, n_spans,
    kept_sha256, starts, ends, passage_words."""
    spark = docs.sparkSession
    chunks = materialize(pack_chunks(distinct_texts(docs, min(length, 2 * count - 1) if count else length), chunk_bytes), "chunks")
    drop_shuffles(spark)
    total = chunks.agg(F.sum("size")).first()[0] or 0
    told = shared_words(chunks, total, count) if count else chunks.select("chunk", F.lit(None).cast("binary").alias("words")).where("false")
    sorter = Sorter(length, order, range_bits(total, order))

    def rank_samples(batches):
        for batch in batches:
            for row in batch.to_pylist():
                sorter.open(row["blob"], row["lengths"])
                if rows := list(sorter.ship(sorter.values(sorter.samples(), sorter.rest), 0, row["chunk"])):
                    yield _rows(rows, SHIPPED)

    def left_open(row):
        sorter.open(row["blob"], row["lengths"])
        flags = {f["bucket"]: f["bits"] for f in row["flags"] or []}
        samples = sorter.samples()
        return sorter.unresolved(samples, sorter.shared(sorter.values(samples, sorter.rest), flags)) if flags else samples[:0]

    def cut_pieces(batches):
        for batch in batches:
            for row in batch.to_pylist():
                rows, held = [], 0
                for anchor, n, starts, text in sorter.pieces(left_open(row)):
                    rows.append((anchor, row["chunk"], n, starts.tobytes(), text))
                    held += len(text)
                    if held > 4 << 20:
                        yield _rows(rows, PIECES)
                        rows, held = [], 0
                if rows:
                    yield _rows(rows, PIECES)

    def cut(batches):
        import zstandard

        for batch in batches:
            for row in batch.to_pylist():
                copies, out = np.frombuffer(row["copies"], np.int64), []
                bounds = np.concatenate([[0], np.cumsum(np.frombuffer(row["lengths"], np.int64))])
                data = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["blob"], max_output_size=int(bounds[-1])), np.uint8)
                edge = np.zeros(len(data) + 1, np.int32)
                for f in row["flags"] or []:
                    tied = np.flatnonzero(np.unpackbits(np.frombuffer(f["bits"], np.uint8)))
                    at = (np.frombuffer(f["starts"], np.int64)[:, None] + tied[None, :]).ravel()
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + length, -1)
                gone = np.cumsum(edge[:-1]) > 0
                held = np.frombuffer(row["words"], np.int64) if row["words"] else np.zeros(len(copies), np.int64)
                for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                    mask, run = gone[a:b], int(held[k])
                    if copies[k] > 1:
                        mask = np.ones(b - a, bool) if b - a >= length else mask
                        run = max(run, n if count and (n := len(words(data[a:b], np.array([0, b - a]), SIGNS)[0])) >= count else 0)
                    if not run and not mask.any():
                        continue
                    turns = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
                    kept = hashlib.sha256(data[a:b][~mask].tobytes()).hexdigest()
                    out.append((row["digests"][32 * k : 32 * k + 32], int(copies[k]), int(mask.sum()), len(turns) // 2, kept, turns[::2].tolist(), turns[1::2].tolist(), run))
                if out:
                    kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["digest", "copies", "n_removed", "n_spans", "kept_sha256", "starts", "ends", "passage_words"])

    ranks = materialize(sort_buckets(chunks.select("chunk", "blob", "lengths").mapInArrow(rank_samples, SHIPPED)), "sample-ranks")
    drop_shuffles(spark)
    pieces = materialize(with_answers(chunks, ranks, "bucket", "bits").select("chunk", "blob", "lengths", "flags").mapInArrow(cut_pieces, PIECES), "pieces")
    drop_shuffles(spark)
    held = pieces.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    hot = materialize(pieces.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("anchor"), "hot-keys")
    dealt = pieces.withColumn("bucket", F.pmod("anchor", F.lit(max(1, -(-held // BUCKET_BYTES)))))
    if hot.isEmpty():
        ties = sort_pieces(dealt, length)
    else:
        ties = sort_pieces(dealt.join(hot, "anchor", "left_anti"), length).unionByName(compare_prints(pieces.join(hot, "anchor", "left_semi"), length))
    ties = materialize(ties, "suffix-ties")
    drop_shuffles(spark)
    result = "digest binary, copies long, n_removed long, n_spans long, kept_sha256 string, starts array<long>, ends array<long>, passage_words long"
    ready = with_answers(chunks, ties, "starts", "bits").join(told, "chunk", "left")
    found = materialize(ready.select("blob", "lengths", "digests", "copies", "flags", "words").mapInArrow(cut, result), "repeats")
    drop_shuffles(spark)
    return found


def remove_repeats(docs: DataFrame, length: int = LENGTH, order: int = ORDER, chunk_bytes: int = CHUNK_BYTES, count: int = WORDS) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, whether it has a run of ``count`` words of
    another document, its words in such runs, and the removed spans in bytes. A ``count`` of 0 seeks no such runs."""
    found = repeats(docs, length, order, chunk_bytes, count)
    text = F.encode(text_or_empty(), "utf-8")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), F.unhex(F.sha2(text, 256)).alias("digest"))
    both = join_groups(rows, found, "digest", "copies", max(1, docs.count()))
    zero = F.lit(0).cast("long")
    return both.select(
        "doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"),
        F.coalesce("kept_sha256", F.lower(F.hex("digest"))).alias("kept_sha256"),
        (F.coalesce("passage_words", zero) > 0).alias("repeats_passage"), F.coalesce("passage_words", zero).alias("passage_words"), "starts", "ends",
    )
