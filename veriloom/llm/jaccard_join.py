"""Similarity join of documents on sets of word shingles, by chosen paths.

Each set becomes 64 minhash tokens, of which two sets of similarity s share a part s in expectation. From the root,
every node of a run samples tokens by a hash of its path, in expectation 1/similarity of them a set, and sends the
set to the child of each sampled token: two sets meet in a bucket only if they chose the same path of shared
tokens. Buckets are searched by brute force on sketches; a bucket that is large splits further on sampled tokens of
its own, as long as that makes it smaller. Runs repeat until a pair at the similarity bound meets with the wanted
recall; with depth 3 a run finds such a pair with probability 0.374.

Within a bucket only a spanning forest of the pairs whose sketches are close leaves the task. The components of all
forests are small groups that hold every true pair; there the exact similarity of all pairs is computed on the whole
shingle sets, in tiles of bounded size, and links and classes are read off. No step emits all pairs of a group.

Texts of equal words are one set with a count, so copies are never compared with each other.

Defined cases: a null or empty text has no shingles, no links and a class of its own; a text under five words is one
shingle; repeated rows are copies and are linked; a null doc_id sorts before others and shows as null; an empty table
gives no rows; other columns pass through ``drop_similar`` untouched and are not read elsewhere.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import build, filter_pages, probe
from .common import drop_shuffles, join_groups, materialize, parts, text_or_empty
from .components import components
from .hashing import U, mix, text_shingles

TOKENS = 64
SIMILARITY = 0.8
RECALL = 0.99999  # for a pair that shares its expected tokens; over the spread of these, 25 runs lose 3 pairs in 100,000 at the bound
DEPTH = 3
CLOSE = 0.58  # share of equal sketch tokens (4 bits each) of a candidate: a pair at the bound has fewer than its 38 with probability 1.3e-5
TILE_SETS, TILE_SHINGLES = 700, 1_500_000
HOT, SAMPLE, PIVOTS = 40_000, 16, 64  # rows of a bucket that is thinned first, the part of rows that finds such buckets, rows that thin it


def runs_for(recall: float, depth: int = DEPTH) -> int:
    """Runs until a pair at the bound meets: a path survives a level as a branching process of mean 1."""
    meet = 1.0
    for _ in range(depth):
        meet = 1 - math.exp(-meet)
    return math.ceil(math.log(1 - recall) / math.log(1 - meet))


def minhashes(hashes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """sets x TOKENS; every set has a shingle."""
    out = np.empty((len(firsts) - 1, TOKENS), U)
    factors = mix(np.arange(1, TOKENS + 1, dtype=U)) | U(1)
    shifts = mix(factors)
    with np.errstate(over="ignore"):
        for k in range(TOKENS):
            part = hashes * factors[k]
            part ^= shifts[k]
            part *= U(0x9FB21C651E98DF25)
            out[:, k] = np.minimum.reduceat(part, firsts[:-1])
    return out


def paths(tokens: np.ndarray, runs: int, depth: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """The leaves that each set reaches in all runs: (row, key)."""
    bound = U(int(2.0**64 / (similarity * tokens.shape[1])))
    rows, keys = [], []
    for run in range(runs):
        row = np.arange(len(tokens))
        key = np.full(len(tokens), mix(np.array([run + 1], U))[0], U)
        for _ in range(depth):
            chance = mix(tokens[row] ^ key[:, None])
            at, token = np.nonzero(chance < bound)
            key, row = mix(chance[at, token] ^ key[at]), row[at]
        rows.append(row)
        keys.append(key)
    return np.concatenate(rows), np.concatenate(keys)


def labelled(tokens: np.ndarray) -> np.ndarray:
    """Tokens as hashes that also name their place, from minhashes or sketch bytes."""
    with np.errstate(over="ignore"):
        return mix(tokens.astype(U) + mix(np.arange(tokens.shape[1], dtype=U) + U(77)))


FEATURES = "doc_id long, row long, match long, sig binary, shingles int, sketch binary, paths binary"


def features(docs: DataFrame, similarity: float, recall: float) -> DataFrame:
    """Signature of the words, number of shingles, sketch and leaves of every document."""
    runs = runs_for(recall)

    def work(batches):
        for batch in parts(batches, 3, 400, 2 << 20):
            hashes, firsts = text_shingles(batch.column(3).to_pylist())
            some = np.flatnonzero(np.diff(firsts))
            out = [[None] * batch.num_rows for _ in range(4)]
            out[1] = np.diff(firsts)
            if len(some):
                starts = np.append(firsts[some], firsts[-1])
                with np.errstate(over="ignore"):
                    place = np.arange(len(hashes), dtype=U) - np.repeat(starts[:-1], np.diff(starts)).astype(U)
                    one = np.add.reduceat(mix(hashes ^ mix(place)), starts[:-1])
                    two = np.add.reduceat(mix(hashes + mix(place + U(9))), starts[:-1])
                tokens = minhashes(hashes, starts)
                row, key = paths(labelled(tokens), runs, DEPTH, similarity)
                order = np.argsort(row, kind="stable")
                edges = np.searchsorted(row[order], np.arange(len(some) + 1))
                sketch = (tokens[:, ::2] & U(15)).astype(np.uint8) << 4 | (tokens[:, 1::2] & U(15)).astype(np.uint8)
                for n, k in enumerate(some.tolist()):
                    out[0][k] = one[n].tobytes() + two[n].tobytes()
                    out[2][k] = sketch[n].tobytes()
                    out[3][k] = np.unique(key[order[edges[n] : edges[n + 1]]]).tobytes()
            kinds = [pa.binary(), pa.int32(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *[pa.array(c, t) for c, t in zip(out, kinds, strict=True)]], names=["doc_id", "row", "match", "sig", "shingles", "sketch", "paths"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), _match().alias("match"), text_or_empty().alias("text"))
    return rows.mapInArrow(work, FEATURES)


def _match():
    return F.xxhash64(F.col("doc_id").cast("long"), text_or_empty())


def packed(sketches: np.ndarray) -> np.ndarray:
    """Sketches (rows x tokens of 4 bits) as words of 16 tokens, words x rows."""
    wide = np.pad(sketches, ((0, 0), (0, -sketches.shape[1] % 16)))
    return np.ascontiguousarray(np.ascontiguousarray(wide[:, ::2] << 4 | wide[:, 1::2]).view(U).T)


def differing(rows: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """The number of tokens in which packed rows differ from a packed one."""
    out = np.zeros(rows.shape[1], np.uint8)
    for k in range(len(rows)):
        x = rows[k] ^ seed[k]
        x |= x >> U(2)
        x |= x >> U(1)
        x &= U(0x1111111111111111)
        out += np.bitwise_count(x)
    return out


def forest(sketches: np.ndarray, close: float) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of rows with enough equal sketch tokens; each row is expanded once."""
    most = sketches.shape[1] - math.ceil(close * sketches.shape[1])
    rows, edges = packed(sketches), []
    left, rest = np.arange(len(sketches)), rows
    while len(left) > 1:
        todo, left, rest = [int(left[0])], left[1:], rest[:, 1:]
        while todo and len(left):
            seed = todo.pop()
            near = differing(rest, rows[:, seed]) <= most
            if near.any():
                found = left[near].tolist()
                edges += [(seed, x) for x in found]
                todo += found
                left, rest = left[~near], rest[:, ~near]
    return edges


def search_bucket(sketches: np.ndarray, key: int, similarity: float, close: float) -> list[tuple[int, int]]:
    """The forest of a bucket of any size. No row is left uncompared, so neither the key nor the bound is needed to split it."""
    return forest(sketches, close)


def candidate_edges(sets: DataFrame, similarity: float, close: float) -> DataFrame:
    """(a, b): forests over rep of all buckets. ``sets`` has rep, sketch, paths."""

    def leaves(batches):
        for batch in batches:
            keys = [np.frombuffer(p, np.int64) for p in batch.column(2).to_pylist()]
            at = np.repeat(np.arange(batch.num_rows), [len(k) for k in keys])
            for k in range(0, len(at), 20_000):
                take = pa.array(at[k : k + 20_000])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)[k : k + 20_000]), batch.column(0).take(take), batch.column(1).take(take)], names=["key", "rep", "sketch"])

    def buckets(batches):
        key, reps, sketches = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, TOKENS), np.uint8)

        def search(bounds):
            a, b = [], []
            for lo, hi in bounds:
                if hi - lo > 1:
                    for x, y in search_bucket(sketches[lo:hi], int(key[lo]), similarity, close):
                        a.append(reps[lo + x])
                        b.append(reps[lo + y])
            if a:
                yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.concatenate([key, batch.column(0).to_numpy()])
            reps = np.concatenate([reps, batch.column(1).to_numpy()])
            packed = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, TOKENS // 2)
            sketches = np.concatenate([sketches, np.stack([packed >> 4, packed & 15], axis=2).reshape(-1, TOKENS)])
            edge = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1])
            yield from search(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True))
            key, reps, sketches = key[edge[-1] :], reps[edge[-1] :], sketches[edge[-1] :]
        if len(key):
            yield from search([(0, len(key))])

    spread, some = (x.select("rep", "sketch", "paths").mapInArrow(leaves, "key long, rep long, sketch binary") for x in (sets, sets.where(_sampled())))
    spread, thinned = _thin(spread, some, close)
    searched = spread.repartition("key").sortWithinPartitions("key").mapInArrow(buckets, "a long, b long")
    return searched if thinned is None else searched.unionByName(thinned)


def _sampled():
    """The part of the sets by which large buckets are told."""
    return F.pmod(F.xxhash64("rep", F.lit("part")), F.lit(SAMPLE)) == 0


def _thin(spread: DataFrame, some: DataFrame, close: float, rounds: int = 4) -> tuple[DataFrame, DataFrame | None]:
    """Takes the rows close to a few pivots out of large buckets before a bucket goes to one task.

    ``some``, the rows of a part of the sets, shows which buckets are large. Each has up to ``PIVOTS`` of its rows as pivots, found by an
    aggregate with partial results; every row close to one or more is linked to them all and leaves the bucket, wherever the row is.
    A row that stays can still be close to one that left, but then it lies within twice the distance of that one's pivot: such rows
    meet the pivot's own in buckets beside. What remains, with the pivots, is searched as a bucket; rounds repeat while large buckets
    remain. A bucket that is still large after them is cut into blocks, each two of which are a bucket.
    """
    edges, beside = None, None
    for last in [False] * rounds + [True]:
        large = materialize(some.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") * SAMPLE > HOT).select("key", (F.col("n") * SAMPLE).alias("size")), "large-buckets")
        if large.isEmpty():
            break
        total = spread.count()
        rows = materialize(join_groups(spread.withColumn("k", F.unhex(F.hex("key"))), large.select(F.unhex(F.hex("key")).alias("k"), "size"), "k", "size", total), "bucket-rows")
        hot, calm = rows.where("size is not null"), rows.where("size is null").select("key", "rep", "sketch")
        if last:
            spread = calm.unionByName(_block_pairs(hot))
            break
        pick = hot.groupBy("k", "size", F.pmod(F.xxhash64("rep"), F.lit(PIVOTS)).alias("slot")).agg(F.min_by(F.struct("rep", "sketch"), F.xxhash64("rep", F.lit("pivot"))).alias("p"))
        pivots = materialize(pick.groupBy("k", "size").agg(F.collect_list("p").alias("pivots")), "pivots")
        judged = join_groups(hot.select("key", "rep", "sketch", "k"), pivots, "k", "size", total)
        near = materialize(judged.select("key", "rep", "sketch", "pivots").mapInArrow(_pivots_of(close), "key long, rep long, sketch binary, pivot long, role string"), "near-pivots")
        linked = near.where("role = 'close'").select(F.col("rep").alias("a"), F.col("pivot").alias("b"))
        edges = linked if edges is None else edges.unionByName(linked)
        met = _around_pivots(near)
        beside = met if beside is None else beside.unionByName(met)
        spread = calm.unionByName(near.where("role = 'stays'").select("key", "rep", "sketch"))
        some = spread.where(_sampled())
    return spread if beside is None else spread.unionByName(beside), edges


def _block_pairs(hot: DataFrame) -> DataFrame:
    """Buckets (key, rep, sketch, size) as buckets of two blocks of at most about HOT / 2 rows, so that any two rows meet in one."""
    blocks = F.greatest(F.lit(2), F.ceil(F.col("size") * 2 / F.lit(HOT))).cast("int")
    dealt = hot.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("rep", F.lit("block")), F.col("blocks")).cast("int"))
    pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("block <> other")
    return pairs.select(F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("key"), "rep", "sketch")


def _around_pivots(near: DataFrame) -> DataFrame:
    """Buckets (key, rep, sketch) in which the rows of a pivot meet those that may be close to one of them, in blocks of at most about HOT / 2 rows."""
    rows = near.where("role in ('own', 'around')")
    count = lambda role: F.count(F.when(F.col("role") == role, 1))
    blocks = lambda n: F.ceil(n * 2 / F.lit(HOT)).cast("int")
    sizes = rows.groupBy("key", "pivot").agg(blocks(count("own")).alias("own"), blocks(count("around")).alias("around"))
    sizes = materialize(sizes.where("own > 0 and around > 0"), "around-pivots")  # at most PIVOTS for every HOT rows
    dealt = rows.join(F.broadcast(sizes), ["key", "pivot"])
    is_own = F.col("role") == "own"
    block = F.pmod(F.xxhash64("rep", F.lit("block")), F.when(is_own, F.col("own")).otherwise(F.col("around"))).cast("int")
    dealt = dealt.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.when(is_own, F.col("around")).otherwise(F.col("own")) - 1)))
    return dealt.select(F.xxhash64("key", "pivot", F.when(is_own, F.col("block")).otherwise(F.col("other")), F.when(is_own, F.col("other")).otherwise(F.col("block"))).alias("key"), "rep", "sketch")


def _pivots_of(close: float):
    """A function over rows with their bucket's pivots: what each row is to them, one row for each role.

    'stays': no pivot is close, or it is one itself; 'close': an edge to a pivot; 'own': leaves the bucket for its closest pivot;
    'around': may be close to a row that another pivot takes. Of two pivots' rows, those of the greater pivot go around the lesser.
    """
    most = TOKENS - math.ceil(close * TOKENS)

    def work(batches):
        for batch in batches:
            at, found, roles = [], [], []
            sketches, pivots = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for k, (rep, sketch, some) in enumerate(zip(batch.column(1).to_pylist(), sketches, pivots, strict=True)):
                reps = [p["rep"] for p in some]
                roles_here = []
                if rep not in reps:
                    far = differing(np.frombuffer(b"".join(p["sketch"] for p in some), U).reshape(len(some), -1).T, np.frombuffer(sketch, U)).tolist()
                    home = min(zip(far, reps, strict=True))[1] if min(far) <= most else None
                    roles_here += [(p, "close") for p, d in zip(reps, far, strict=True) if d <= most]
                    roles_here += [(p, "around") for p, d in zip(reps, far, strict=True) if most < d <= 2 * most and (home is None or p < home)]
                else:
                    home = None
                roles_here.append((home, "own") if home is not None else (None, "stays"))
                at += [k] * len(roles_here)
                found += [p for p, _ in roles_here]
                roles += [r for _, r in roles_here]
            for lo in range(0, len(at), 20_000):
                take, cut = pa.array(at[lo : lo + 20_000], pa.int64()), slice(lo, lo + 20_000)
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(take) for c in range(3)], pa.array(found[cut], pa.int64()), pa.array(roles[cut], pa.string())], names=["key", "rep", "sketch", "pivot", "role"])

    return work


def exact_links(sets: list[np.ndarray], sizes: np.ndarray, similarity: float, side: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Links of each set, each linked set counting its copies, and the least index of its component in the tile.

    With ``side`` (0 or 1), only pairs across the sides count.
    """
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    edge = np.concatenate([[True], flat[1:] != flat[:-1]])
    column = np.cumsum(edge) - 1
    shared = np.bincount(column)[column] > 1
    column, owner = np.unique(column[shared], return_inverse=True)[1], owner[shared]
    both = np.zeros((n, n), np.float32)
    total = int(column[-1]) + 1 if len(column) else 0
    for lo in range(0, total, 4096):
        a, b = np.searchsorted(column, [lo, lo + 4096])
        slab = np.zeros((n, min(4096, total - lo)), np.float32)
        slab[owner[a:b], column[a:b] - lo] = 1
        both += slab @ slab.T
    length = np.array([len(s) for s in sets], np.float64)
    linked = both >= similarity * (length[:, None] + length[None, :] - both) - 1e-6
    np.fill_diagonal(linked, False)
    if side is not None:
        linked &= side[:, None] != side[None, :]
    root = np.arange(n)
    while True:
        new = np.minimum(root, np.where(linked, root[None, :], n).min(axis=1, initial=n))
        new = np.minimum(new, new[new])
        if (new == root).all():
            return linked @ sizes.astype(np.float64), root
        root = new


def groups(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> tuple[DataFrame, DataFrame]:
    """The features of every document, and for each signature with copies or links its class."""
    spark = docs.sparkSession
    every = materialize(features(docs, similarity, recall), "features")
    drop_shuffles(spark)
    first = F.struct("doc_id", "row")
    sets = every.where(F.col("sig").isNotNull()).groupBy("sig").agg(F.min(first).alias("m"), F.count("*").alias("size"), F.min_by(F.struct("match", "shingles", "sketch", "paths"), first).alias("f"))
    sets = materialize(sets.select("sig", F.col("m.row").alias("rep"), F.col("m.doc_id").alias("doc"), "size", "f.*"), "sets")
    drop_shuffles(spark)
    roots = materialize(components(candidate_edges(sets, similarity, CLOSE)), "candidates")
    drop_shuffles(spark)
    members = sets.select("rep", "doc", "size", "match", "shingles").join(roots.withColumnRenamed("node", "rep"), "rep")
    tiles = roots.join(sets.select(F.col("rep").alias("node"), "shingles"), "node").groupBy("root").agg(F.count("*").alias("n"), F.sum("shingles").alias("s"))
    blocks = F.ceil(F.greatest(F.col("n") / F.lit(TILE_SETS), F.col("s") / F.lit(TILE_SHINGLES))).cast("int")
    members = materialize(members.join(tiles.select("root", blocks.alias("blocks")), "root"), "members")
    found = materialize(_verified(docs, members, similarity), "links")
    drop_shuffles(spark)
    whole = found.where("blocks = 1").select("rep", "links", F.col("label").alias("class_rep"))
    split = found.where("blocks > 1")
    merged = components(split.select(F.col("rep").alias("a"), F.col("label").alias("b"))).withColumnRenamed("root", "class_rep") if not split.isEmpty() else None
    sums = split.groupBy("rep").agg(F.sum("links").alias("links"))
    linked = whole if merged is None else whole.unionByName(sums.join(merged.withColumnRenamed("node", "rep"), "rep", "left").withColumn("class_rep", F.coalesce("class_rep", "rep")))
    named = sets.select("sig", "rep", "doc", "size").join(linked, "rep", "left").withColumn("class_rep", F.coalesce("class_rep", "rep"))
    named = materialize(named.where(F.col("links").isNotNull() | (F.col("size") > 1)), "classes")
    best = named.groupBy("class_rep").agg(F.min(F.struct("doc", "rep")).alias("best"))
    classes = named.join(best, "class_rep").select(
        "sig", "size", F.col("best.doc").alias("class_id"), F.col("best.rep").alias("class_row"),
        (F.coalesce("links", F.lit(0.0)) + F.col("size") - 1).cast("long").alias("n_links"),
    )
    return every, materialize(classes, "class-table")


def _maybe_in(rows: DataFrame, members: DataFrame, inside: bool = True) -> DataFrame:
    """The rows whose match may be (or, not inside, certainly is not) among the members', without a shuffle of texts."""
    pages = filter_pages(members.count())
    bitmaps = materialize(build(members.select("match"), "match", pages), "filter")
    return probe(rows, "match", pages, bitmaps, "__hit").where("__hit" if inside else "not __hit").drop("__hit")


def _verified(docs: DataFrame, members: DataFrame, similarity: float) -> DataFrame:
    """Exact links within each tile: root, blocks, rep, links, label (the least member linked to it there)."""
    texts = docs.select(_match().alias("match"), text_or_empty().alias("text"))
    texts = _maybe_in(texts, members).join(members, "match")
    texts = texts.groupBy("match").agg(*[F.first(c).alias(c) for c in ("rep", "root", "blocks", "size", "text")])  # on the join's own key

    def shingled(batches):
        for batch in parts(batches, 4, 400, 2 << 20):
            hashes, firsts = text_shingles(batch.column(4).to_pylist())
            sets = [np.unique(hashes[a:b]).tobytes() for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(4)], pa.array(sets, pa.binary())], names=["rep", "root", "blocks", "size", "set"])

    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    rows = texts.select("rep", "root", "blocks", "size", "text").mapInArrow(shingled, "rep long, root long, blocks int, size long, set binary")
    tiled = rows.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiled = tiled.withColumn("tile", F.xxhash64("root", F.least("block", "other"), F.greatest("block", "other")))

    def tile_rows(roots, blocks, reps, sizes, sets, sides, others):
        same = all(a == b for a, b in zip(sides, others, strict=True))
        side = None if same else np.array([int(a > b) for a, b in zip(sides, others, strict=True)])
        order = np.argsort(np.array(reps, np.int64))
        reps, sizes = np.array(reps, np.int64)[order], np.array(sizes, np.int64)[order]
        links, root = exact_links([np.frombuffer(sets[k], U) for k in order], sizes, similarity, side if side is None else side[order])
        return [(roots[0], blocks[0], int(r), float(x), int(reps[c])) for r, x, c in zip(reps, links, root, strict=True)]

    def search(batches):
        kept = None
        names = ["root", "blocks", "rep", "links", "label"]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.int64()]

        def done(held):
            out, tile = [], held.column("tile").to_numpy()
            edge = np.concatenate([[0], np.flatnonzero(np.diff(tile)) + 1, [len(tile)]])
            for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                if hi - lo > 1:
                    part = held.slice(lo, hi - lo).to_pydict()
                    out += tile_rows(part["root"], part["blocks"], part["rep"], part["size"], part["set"], part["block"], part["other"])
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names) if out else None

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            kept = table if kept is None else pa.concat_tables([kept, table])
            tile = kept.column("tile")
            last = tile[-1].as_py()
            n = len(tile) - 1
            while n >= 0 and tile[n].as_py() == last:
                n -= 1
            if n >= 0 and (got := done(kept.slice(0, n + 1).combine_chunks())) is not None:
                yield got
            kept = kept.slice(n + 1)
        if kept is not None and len(kept) and (got := done(kept.combine_chunks())) is not None:
            yield got

    return tiled.select("tile", "root", "blocks", "rep", "size", "set", "block", "other").repartition("tile").sortWithinPartitions("tile").mapInArrow(search, "root long, blocks int, rep long, links double, label long")


def similar_groups(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """One row per document: doc_id, class_id (least doc_id of its component), n_links, copies (rows of equal words)."""
    every, classes = groups(docs, similarity, recall)
    total = every.count()
    rows = every.select("doc_id", F.coalesce("sig", F.encode(F.concat(F.lit("-"), F.col("row").cast("string")), "utf-8")).alias("sig"))
    both = join_groups(rows, classes.withColumn("grouped", F.lit(True)), "sig", "size", total)
    return both.select(
        "doc_id", F.when(F.col("grouped"), F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("size", F.lit(1).cast("long")).alias("copies"),
    )


def drop_similar(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """The rows of ``docs``, all columns, of which one row of each class stays: that of the least doc_id."""
    every, classes = groups(docs, similarity, recall)
    total = every.count()
    joined = join_groups(every.where(F.col("sig").isNotNull()).select("row", "match", "sig"), classes, "sig", "size", total)
    decided = materialize(joined.select("match", (F.col("class_row").isNull() | (F.col("class_row") == F.col("row"))).alias("stays")), "decisions")
    gone = decided.groupBy("match").agg(F.max("stays").alias("stays"), F.count("*").alias("n"))
    gone = materialize(gone.where("not stays or n > 1"), "gone")
    every = docs.select(F.struct("*").alias("row"), _match().alias("match"))
    clear, whole = _maybe_in(every, gone, False), _maybe_in(every, gone)
    kept = whole.join(gone.where("not stays").select("match"), "match", "left_anti")
    again = gone.where("stays and n > 1").select("match")
    once = kept.join(again, "match", "left_anti").select("row")
    repeated = kept.join(again, "match", "left_semi").groupBy("match").agg(F.max_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
    return clear.select("row").unionByName(once).unionByName(repeated.select("row")).select("row.*")
