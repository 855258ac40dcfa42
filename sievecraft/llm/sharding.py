"""Sharding: constant-time placement through a permutation-filled lookup table.

Each shard prefers the table's slots in an order of its own (an arithmetic progression
modulo the prime table size). Shards take turns claiming the next free slot they prefer,
so that slots are spread evenly and few of them move when a shard comes or goes. A row
looks its slot up by the hash of its key.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh

SHARDS = 64
TABLE_SIZE = 65537


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], size: int = TABLE_SIZE) -> np.ndarray:
    """Slot -> index of its shard. size: a prime, no less than the number of shards."""
    if not shards or len(set(shards)) != len(shards) or not _is_prime(size) or size < len(shards):
        raise ValueError("shards must be distinct and not none, size a prime no less than their number")
    seeds = [hashlib.blake2b(s.encode(), digest_size=16).digest() for s in shards]
    at = np.array([int.from_bytes(s[:8], "little") % size for s in seeds])
    skip = np.array([int.from_bytes(s[8:], "little") % (size - 1) + 1 for s in seeds]) if size > 2 else np.ones(len(shards), int)
    table, left = np.full(size, -1, np.int32), size
    at, skip = at.tolist(), skip.tolist()
    taken = bytearray(size)
    while left:
        for k in range(len(shards)):
            slot = at[k]
            while taken[slot]:
                slot = (slot + skip[k]) % size
            taken[slot], table[slot], at[k] = 1, k, (slot + skip[k]) % size
            left -= 1
            if not left:
                break
    return table


def table_frame(spark: SparkSession, shards: list[str], size: int = TABLE_SIZE) -> DataFrame:
    table = lookup_table(shards, size)
    return spark.createDataFrame([(i, int(k), shards[k]) for i, k in enumerate(table)], "slot long, shard int, shard_name string")


def place(df: DataFrame, shards: list[str], key_col: str = "doc_id", size: int = TABLE_SIZE, into: tuple[str, str, str] = ("slot", "shard", "shard_name")) -> DataFrame:
    """df with each row's slot and shard; the table that is broadcast has `size` rows, whatever df's size.

    Defined cases: the key is hashed as text; a null key is hashed as the empty text, like
    an empty key, so all such rows share a shard; equal keys and repeated rows share a shard;
    very long texts are not looked at; an empty table stays empty. Columns of df named as one
    of `into` give way to the new ones, all others stay.
    """
    slot = F.pmod(F.xxhash64(F.coalesce(F.col(f"`{key_col}`").cast("string"), F.lit(""))), F.lit(size).cast("long"))
    kept = [F.col(f"`{c}`") for c in df.columns if c not in into]
    (hidden,) = fresh(df.select(*df.columns, *[F.lit(0).alias(x) for x in into if x not in df.columns]), "slot_of_row")
    table = table_frame(df.sparkSession, shards, size).select(F.col("slot").alias(hidden), F.col("slot").alias(into[0]), F.col("shard").alias(into[1]), F.col("shard_name").alias(into[2]))
    return df.select(*kept, slot.alias(hidden)).join(F.broadcast(table), hidden, "left").drop(hidden)


def write_shards(df: DataFrame, path: str, shards: list[str], key_col: str = "doc_id", files_per_shard: int = 4, size: int = TABLE_SIZE) -> None:
    """df as Parquet under path/shard=<number>. A shard's rows are dealt to files_per_shard tasks by all their columns, so no task gets a whole shard.

    A column of df named shard gives way to the number; other cases as in place(). An empty
    table writes no shard.
    """
    into = (*fresh(df, "slot"), "shard", *fresh(df, "shard_name"))
    placed = place(df, shards, key_col, size, into).drop(into[0], into[2])
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns if c != "shard"]), F.lit(files_per_shard))
    placed.repartition(len(shards) * files_per_shard, "shard", salt).write.partitionBy("shard").parquet(path)
