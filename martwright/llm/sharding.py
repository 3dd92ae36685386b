"""Sharding by a permutation-filled lookup table.

Each shard prefers the slots of a table of prime size in an order of its own: an offset and a step, both hashes of its
name, run through every slot. The shards take turns claiming the next free slot they prefer until the table is full.
A row's slot is a hash of its key modulo the table's size, so placing it is one look into the table, whose size is fixed
whatever the data. Shards' shares differ by at most one slot, and a shard that leaves frees few slots of the others.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, without

TABLE_SIZE = 65_537
MOST_SLOTS = 1_000_003  # the lookup table is broadcast: 8 MB at most


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def preference(name: str, size: int) -> tuple[int, int]:
    """(offset, step) of a shard's walk; with a prime size every step from 1 to size - 1 reaches all slots."""
    h = sha256(name.encode()).digest()
    return int.from_bytes(h[:8], "big") % size, int.from_bytes(h[8:16], "big") % (size - 1) + 1


def fill(shards: list[str], size: int = TABLE_SIZE) -> np.ndarray:
    """The shard number of every slot."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be named, each once")
    if not is_prime(size) or size < len(shards) or size > MOST_SLOTS:
        raise ValueError(f"the table's size must be a prime from the number of shards to {MOST_SLOTS}")
    walks = [preference(s, size) for s in shards]
    at, step = [w[0] for w in walks], [w[1] for w in walks]
    table, free = [-1] * size, size
    while free:
        for k in range(min(len(shards), free)):
            slot = at[k]
            while table[slot] >= 0:
                slot = (slot + step[k]) % size
            table[slot] = k
            at[k] = (slot + step[k]) % size
        free -= min(len(shards), free)
    return np.array(table, np.int32)


def place(docs: DataFrame, shards: list[str], key_col: str = "doc_id", size: int = TABLE_SIZE) -> DataFrame:
    """docs with slot (int) and shard (string); a narrow step, the table goes to the executors as a broadcast.

    The key is hashed as text; a null key counts as the empty text, so all such rows share a shard, as do repeated keys.
    Keys of any length are hashed whole. An empty table gives an empty result. Further columns stay, whatever their names;
    columns named slot or shard are replaced.
    """
    table = fill(shards, size)
    docs = docs.select(*without(docs.columns, "slot", "shard"))
    (number,) = fresh([*docs.columns, "slot", "shard"], "number")
    names = docs.sparkSession.createDataFrame([(i, shards[k]) for i, k in enumerate(table.tolist())], f"{number} int, shard string")
    slot = F.pmod(F.xxhash64(F.coalesce(F.col(key_col).cast("string"), F.lit(""))), F.lit(size)).cast("int")
    return docs.withColumn("slot", slot).join(F.broadcast(names), F.col("slot") == F.col(number)).drop(number)
