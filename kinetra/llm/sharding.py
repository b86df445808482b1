"""Sharding by a permutation-filled lookup table.

Shards take turns claiming slots of a table of prime size, each by its own preference order (offset + turn * skip). The
table is small and of fixed size, so it is broadcast, and each row is placed in constant time by its key's hash. When a
shard leaves, few slots of the others change hands.

Defined results: a null key has a slot like any other key; rows that repeat go to one shard; an empty table gives no
rows; columns of df that are named like the new ones are replaced (other extra columns stay); shards of weight w claim w slots a turn; shards are named by distinct strings and at least one is needed.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TABLE_SIZE = 65_537


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def _number(name: str, salt: str) -> int:
    return int.from_bytes(hashlib.sha256(f"{salt}:{name}".encode()).digest()[:8], "big")


def lookup_table(shards: list[str], size: int = TABLE_SIZE, weights: dict[str, int] | None = None) -> np.ndarray:
    """The shard number of each slot."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct and at least one")
    if not _is_prime(size) or size < len(shards):
        raise ValueError("the size must be a prime and no less than the number of shards")
    orders = [(_number(s, "offset") % size, _number(s, "skip") % (size - 1) + 1) for s in shards]
    turns = [max(1, (weights or {}).get(s, 1)) for s in shards]
    table, at, left = np.full(size, -1, dtype=np.int32), [0] * len(shards), size
    while left:
        for k, (offset, skip) in enumerate(orders):
            for _ in range(turns[k]):
                if not left:
                    break
                while table[slot := (offset + at[k] * skip) % size] >= 0:
                    at[k] += 1
                table[slot] = k
                at[k] += 1
                left -= 1
    return table


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """The first 60 bits of the key's MD5, modulo the size; null counts as an empty string's neighbour `null`."""
    return F.pmod(F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null"))), 1, 15), 16, 10).cast("long"), F.lit(size))


def place(df: DataFrame, key_col: str, shards: list[str], size: int = TABLE_SIZE, weights: dict[str, int] | None = None, slot_col: str = "slot", shard_col: str = "shard") -> DataFrame:
    """df with the columns slot and shard (a number). No shuffle: the broadcast side has exactly `size` rows."""
    table = lookup_table(shards, size, weights)
    slots = df.sparkSession.createDataFrame([(k, int(s)) for k, s in enumerate(table)], "_slot long, _shard int")
    kept = [c for c in df.columns if c not in (slot_col, shard_col)]
    placed = df.select(*kept, slot_of(F.col(key_col), size).alias("_slot")).join(F.broadcast(slots), "_slot")
    return placed.select(*kept, F.col("_slot").alias(slot_col), F.col("_shard").alias(shard_col))
