"""Operator 2: constant-time shard placement by a permutation-filled lookup table."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A prime; the table stays this long whatever the data, so it may be broadcast.
SLOTS = 65_537
MAX_SLOTS = 1_000_003


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def _number(text: str) -> int:
    return int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "big")


def fill_table(shards: list[str], slots: int = SLOTS) -> np.ndarray:
    """For each slot the number of the shard that claims it.

    Every shard walks the slots in an order of its own, offset + j * skip modulo the prime number of slots. In
    turns, each shard claims the next free slot of its order, so shares differ by at most one slot, and adding
    or removing a shard moves little beyond its own share. Names must be distinct; their order is irrelevant
    because turns go by sorted name.
    """
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shard names must be given and distinct")
    if not _is_prime(slots) or slots < len(shards) or slots > MAX_SLOTS:
        raise ValueError(f"slots must be a prime, from the number of shards to {MAX_SLOTS}")
    order = sorted(range(len(shards)), key=lambda i: shards[i])
    place = {i: _number(f"offset:{shards[i]}") % slots for i in order}
    skip = {i: _number(f"skip:{shards[i]}") % (slots - 1) + 1 for i in order}
    table = np.full(slots, -1, np.int32)
    free = slots
    while free:
        for i in order:
            while table[place[i]] >= 0:
                place[i] = (place[i] + skip[i]) % slots
            table[place[i]] = i
            free -= 1
            if not free:
                break
    return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """A key's slot: the first 60 bits of the md5 of its text (null: of the empty text), modulo ``slots``."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(slots)).cast("int")


def lookup_table(spark: SparkSession, shards: list[str], slots: int = SLOTS) -> DataFrame:
    table = fill_table(shards, slots)
    rows = [(i, int(k), shards[k]) for i, k in enumerate(table)]
    return spark.createDataFrame(rows, "slot int, shard int, shard_name string")


def assign_shards(df: DataFrame, key: str, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """``df`` with slot, shard and shard_name. Nothing is shuffled: the table (at most ``MAX_SLOTS`` rows) is broadcast.

    Columns of these names in ``df`` are replaced. Equal keys share a shard; a null key is placed like an empty one.
    """
    df = df.drop("slot", "shard", "shard_name").withColumn("slot", slot_of(F.col(key), slots))
    return df.join(F.broadcast(lookup_table(df.sparkSession, shards, slots)), "slot", "left")


def write_shards(df: DataFrame, key: str, shards: list[str], path: str, slots: int = SLOTS) -> None:
    """Write ``df`` as one folder of Parquet files per shard. Tasks write what they hold: no shard is gathered in a task."""
    assign_shards(df, key, shards, slots).drop("slot", "shard").write.partitionBy("shard_name").parquet(path)
