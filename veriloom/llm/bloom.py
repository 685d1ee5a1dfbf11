"""Blocked Bloom filters as rows of 4 KB bitmap pages, in DataFrame functions only.

A 64-bit hash chooses a page by its upper bits and two slots in that page by its lower ones. Pages are rows, so a
filter of any size is an ordinary table; up to MAX_FILTER_BYTES it is broadcast, beyond that joined by shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE_BITS = 32768  # the width of Spark's bitmap_construct_agg
MAX_FILTER_BYTES = 64 << 20


def _page(h: str, pages: int) -> Column:
    return F.pmod(F.shiftrightunsigned(F.col(h), 32), F.lit(pages)).cast("long")


def _slots(h: str) -> list[Column]:
    return [F.col(h).bitwiseAND(PAGE_BITS - 1), F.shiftrightunsigned(F.col(h), 15).bitwiseAND(PAGE_BITS - 1)]


def filter_pages(rows: int, bits_per_row: int = 16) -> int:
    """Pages for a filter of at least bits_per_row bits a row, a power of two."""
    return 1 << max(0, math.ceil(math.log2(max(1, rows * bits_per_row / PAGE_BITS))))


def build(hashes: DataFrame, h: str, pages: int, least: int = 1) -> DataFrame:
    """(page, bitmap) with a bit for each slot that at least ``least`` rows set."""
    slot = F.explode(F.array_distinct(F.array(*_slots(h))))
    counted = hashes.select(_page(h, pages).alias("page"), slot.alias("slot")).groupBy("page", "slot").count()
    return counted.where(F.col("count") >= least).groupBy("page").agg(F.expr("bitmap_construct_agg(slot)").alias("bitmap"))


def probe(rows: DataFrame, h: str, pages: int, bitmaps: DataFrame, hit: str) -> DataFrame:
    """Adds ``hit``, false for rows whose hash is certainly not in the filter."""
    small = pages * PAGE_BITS // 8 <= MAX_FILTER_BYTES
    found = bitmaps.select(F.col("page").alias("__page"), F.col("bitmap").alias("__bitmap"))
    joined = rows.withColumn("__page", _page(h, pages)).join(F.broadcast(found) if small else found, "__page", "left")

    def is_set(slot: Column) -> Column:
        byte = F.conv(F.hex(F.substring("__bitmap", F.shiftright(slot, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return F.getbit(byte, slot.bitwiseAND(7).cast("int")) == 1

    both = is_set(_slots(h)[0]) & is_set(_slots(h)[1])
    return joined.withColumn(hit, F.coalesce(both, F.lit(False))).drop("__page", "__bitmap")
