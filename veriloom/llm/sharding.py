"""Consistent sharding by a permutation-filled lookup table, placement in DataFrame functions only.

Each shard has its own preference order over the slots of a prime-sized table (offset and skip from the hash of
its name). The shards take turns: each claims the first slot of its order that is still free, until the table is
full. The table has ``slots`` rows, a parameter and never a function of the data, so it is broadcast; a row's
shard is the entry at (hash of its key) mod ``slots``. Removing a shard moves its own slots and few others.

Defined cases: a null key is placed as the empty string; equal keys share a shard; an empty table gives an empty
result; the output has only the named columns, so other columns of the input cannot clash.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHARDS = 16
SLOTS = 2039


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def claim_slots(names: list[str], slots: int = SLOTS) -> list[int]:
    """The lookup table: for each slot the index of the shard that claimed it."""
    if slots < max(2, len(names)) or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime that is at least the number of shards")
    start = [_number(f"{n}:offset") % slots for n in names]
    skip = [_number(f"{n}:skip") % (slots - 1) + 1 for n in names]
    owner, tried, free = [-1] * slots, [0] * len(names), slots
    while free:
        for shard in range(len(names)):
            while owner[slot := (start[shard] + tried[shard] * skip[shard]) % slots] >= 0:
                tried[shard] += 1
            owner[slot] = shard
            free -= 1
            if not free:
                break
    return owner


def shard_names(n: int = SHARDS) -> list[str]:
    return [f"shard-{i:03d}" for i in range(n)]


def lookup_table(spark: SparkSession, names: list[str], slots: int = SLOTS) -> DataFrame:
    """(slot, shard) from one literal array: no Python on executors."""
    owners = F.array(*[F.lit(x) for x in claim_slots(names, slots)])
    return spark.range(1).select(F.posexplode(owners).alias("slot", "shard"))


def key_slot(key: Column, slots: int = SLOTS) -> Column:
    """A key's slot, from the first 60 bits of its MD5, which any SQL engine can repeat."""
    digest = F.md5(F.encode(F.coalesce(key.cast("string"), F.lit("")), "utf-8"))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(slots)).cast("int")


def place(rows: DataFrame, key: str = "doc_id", shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """One row per input row: the key, its slot and its shard."""
    lookup = lookup_table(rows.sparkSession, shard_names(shards), slots)
    keyed = rows.select(F.col(key).alias("__key"), key_slot(F.col(key), slots).alias("slot"))
    return keyed.join(F.broadcast(lookup), "slot").select(F.col("__key").alias(key), "slot", "shard")


def write_shards(rows: DataFrame, path: str, key: str = "doc_id", shards: int = SHARDS, slots: int = SLOTS, tasks_per_shard: int = 8) -> None:
    """Write all columns of ``rows`` into one folder per shard; each shard is spread over several writers."""
    lookup = lookup_table(rows.sparkSession, shard_names(shards), slots)
    placed = rows.select(F.struct("*").alias("row"), key_slot(F.col(key), slots).alias("slot")).join(F.broadcast(lookup), "slot")
    salt = F.pmod(F.xxhash64(F.to_json("row")), F.lit(tasks_per_shard))
    spread = placed.repartition(shards * tasks_per_shard, F.col("shard"), salt)
    spread.select(F.col("shard").alias("__shard"), "row.*").write.partitionBy("__shard").parquet(path)
