"""Shards by a permutation-filled lookup table.

Each shard has an order in which it prefers the slots of a table whose size is prime. The shards take
turns, each claiming its first slot that is still free, until the table is full. A row's key hashes to a
slot and the slot names its shard. Every shard gets the same number of slots but for one, and taking a
shard away moves few rows besides its own.

The table has a fixed size, so it is made from parameters alone and broadcast; the rows never shuffle.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLE_SIZE = 65_537
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def claimed_slots(shards: Sequence[str], size: int = TABLE_SIZE) -> list[int]:
    """For each slot the position of its shard in ``shards``.

    A shard's preference is ``offset + i * step`` modulo the prime size, offset and step being hashes of its name.
    """
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards need distinct names, one at least")
    if len(shards) > size or size < 2 or any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError("the table's size has to be a prime no smaller than the number of shards")
    wants = [xxhash.xxh64_intdigest(s, seed=1) % size for s in shards]
    steps = [xxhash.xxh64_intdigest(s, seed=2) % (size - 1) + 1 for s in shards]
    slots, free = [-1] * size, size
    while free:
        for shard, step in enumerate(steps):
            slot = wants[shard]
            while slots[slot] >= 0:
                slot = (slot + step) % size
            slots[slot], wants[shard] = shard, (slot + step) % size
            free -= 1
            if not free:
                break
    return slots


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """The slot of a key of any type, by its text; all null keys have one slot."""
    return F.pmod(F.xxhash64(F.coalesce(key.cast("string"), F.lit("\0null"))), F.lit(size)).cast("int")


def place(df: DataFrame, key: str, shards: Sequence[str] = SHARDS, size: int = TABLE_SIZE, slot: str = "slot", shard: str = "shard") -> DataFrame:
    """``df`` with the columns ``slot`` and ``shard`` (existing columns of these names are replaced).

    Rows with one key go to one shard; a row costs one look-up, whatever the number of shards. An empty
    table stays empty.
    """
    lookup = lookup_table(df.sparkSession, shards, size)
    hashed = df.drop(slot, shard).withColumn(slot, slot_of(df[key], size))
    return hashed.join(F.broadcast(lookup), hashed[slot] == lookup["_slot"]).drop("_slot").withColumnRenamed("_shard", shard)


def lookup_table(spark: SparkSession, shards: Sequence[str] = SHARDS, size: int = TABLE_SIZE) -> DataFrame:
    """The filled table: ``_slot``, ``_shard``; ``size`` rows whatever the data."""
    owners = F.from_json(F.lit(json.dumps(claimed_slots(shards, size))), "array<int>")
    names = F.array(*map(F.lit, shards))
    return spark.range(1).select(F.posexplode(owners).alias("_slot", "_owner")).select("_slot", F.element_at(names, F.col("_owner") + 1).alias("_shard"))
