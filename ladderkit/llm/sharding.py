"""Sharding by a permutation-filled lookup table.

Each shard name gives a permutation of the slots of a prime-sized table (an offset and a
stride from its digest). The shards take turns claiming their next free preferred slot until
the table is full, so every shard owns nearly the same number of slots, and a shard that is
added or removed moves few other slots. The table is broadcast (its size is the ``slots``
parameter, whatever the data) and a row's place is one hash and one lookup.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 65_537
SHARDS = 128


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n ** 0.5) + 1))


def fill_table(names: list[str], slots: int = SLOTS) -> np.ndarray:
    """int32 array of length ``slots``: the index in ``names`` of the shard that owns each slot.

    Raises ValueError for a size that is not prime, for no or repeated names and for more
    names than slots. The order of ``names`` only decides who chooses first.
    """
    if not _is_prime(slots):
        raise ValueError(f"the table size must be prime, not {slots}")
    if not names or len(set(names)) != len(names) or len(names) > slots:
        raise ValueError("names must be distinct, at least one and at most one per slot")
    digests = [hashlib.md5(n.encode()).digest() for n in names]
    at = [int.from_bytes(d[:8], "big") % slots for d in digests]
    step = [int.from_bytes(d[8:], "big") % (slots - 1) + 1 for d in digests]
    owner = np.full(slots, -1, np.int32)
    free = slots
    while free:
        for shard in range(len(names)):
            slot = at[shard]
            while owner[slot] >= 0:
                slot = (slot + step[shard]) % slots
            owner[slot] = shard
            at[shard] = (slot + step[shard]) % slots
            free -= 1
            if not free:
                break
    return owner


def place(df: DataFrame, key: Column | str, names: list[str] | int = SHARDS, slots: int = SLOTS,
          slot_col: str = "slot", shard_col: str = "shard") -> DataFrame:
    """``df`` with the slot (long) and shard (int) of each row.

    A null key hashes like any value (all nulls share one slot); equal keys share a slot;
    an empty table stays empty. Existing columns called like the new ones are replaced.
    """
    names = [f"shard-{i:05d}" for i in range(names)] if isinstance(names, int) else names
    owner = fill_table(names, slots)
    lookup = df.sparkSession.createDataFrame(
        pd.DataFrame({"__slot": np.arange(slots, dtype=np.int64), "__shard": owner}))
    key = F.col(key) if isinstance(key, str) else key
    return (df.withColumn("__slot", F.pmod(F.xxhash64(key), F.lit(slots)))
            .join(F.broadcast(lookup), "__slot", "left")
            .withColumn(slot_col, F.col("__slot")).withColumn(shard_col, F.col("__shard"))
            .drop("__slot", "__shard"))


def write_shards(df: DataFrame, path: str, key: Column | str, names: list[str] | int = SHARDS,
                 slots: int = SLOTS, files_per_shard: int = 4) -> None:
    """Write one folder per shard. A shard is dealt over ``files_per_shard`` tasks by a hash of
    the whole row, so a key with very many rows does not end in one task."""
    placed = place(df, key, names, slots)
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(files_per_shard))
    placed.repartition("shard", salt).write.partitionBy("shard").parquet(path)
