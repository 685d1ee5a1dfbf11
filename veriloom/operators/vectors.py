"""Cosines of many vectors with many, in tiles of bounded size."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TILE, SLICE = 4096, 512
PAIRS = "a long, own long, b long, src long, cos double"


def blocks_for(n: int) -> int:
    """Blocks of at most about ``TILE`` vectors, and several even of few, so that there is work for many tasks."""
    return max(1, math.ceil(n / TILE), min(4, n // 128))


def tiled_cosines(left: DataFrame, right: DataFrame, floor: float | None = None, lower: bool = False) -> DataFrame:
    """a, own, b, src, cos of pairs of ``left`` with ``right``; both have (id, label, embedding).

    Vectors are dealt into blocks by a hash of their id, and each pair of blocks is a task's tile: a matrix product of
    unit vectors, a slice of rows at a time. Only pairs that reach ``floor`` leave a tile. ``lower`` keeps the pairs
    whose first label is the lesser one, else a vector's pair with itself is left out. A vector of norm 0 has cosine 0
    with all; null vectors meet nothing. Work is that of all pairs, memory that of one tile.
    """
    sides = []
    n_left, n_right = blocks_for(left.count()), blocks_for(right.count())
    for side, rows, mine, others in (("l", left, n_left, n_right), ("r", right, n_right, n_left)):
        dealt = rows.where("embedding is not null").select(F.lit(side).alias("side"), F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), "embedding", F.pmod(F.xxhash64("id"), F.lit(mine)).alias("mine"))
        both = ("mine", "other") if side == "l" else ("other", "mine")
        sides.append(dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(others - 1)))).select("side", "id", "label", "embedding", *[F.col(c).cast("int").alias(k) for c, k in zip(both, ("row", "column"), strict=True)]))

    def unit(table: pa.Table):
        ids, labels = table.column("id").to_numpy(), table.column("label").to_numpy()
        vectors = table.column("embedding").combine_chunks()
        vectors = np.asarray(vectors.flatten(), np.float64).reshape(len(ids), -1) if len(ids) else np.zeros((0, 0))
        norms = np.sqrt((vectors * vectors).sum(1, keepdims=True))
        return ids, labels, vectors / np.where(norms > 0, norms, 1.0)

    def tile(key, table):
        is_left = pc.equal(table.column("side"), "l")
        (a, own, x), (b, src, y) = unit(table.filter(is_left)), unit(table.filter(pc.invert(is_left)))
        found = []
        for at in range(0, len(a) if len(b) else 0, SLICE):
            cos = x[at : at + SLICE] @ y.T
            keep = own[at : at + SLICE, None] < src[None, :] if lower else a[at : at + SLICE, None] != b[None, :]
            if floor is not None:
                keep &= cos >= floor
            i, j = np.nonzero(keep)
            found.append((a[at + i], own[at + i], b[j], src[j], cos[i, j]))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 4 + [np.zeros(0)]
        return pa.table(columns, names=["a", "own", "b", "src", "cos"])

    return sides[0].unionByName(sides[1]).groupBy("row", "column").applyInArrow(tile, PAIRS)
