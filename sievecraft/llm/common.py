"""What the operators of this package share."""

from __future__ import annotations

import contextlib
import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.storage import discard, files_for, materialize, release, shared_dir

__all__ = ["discard", "files_for", "fresh", "id_and_text", "materialize", "sieved", "release", "shared_dir", "text_or_empty", "tidy"]


def tidy(*caches: dict) -> None:
    """At a task's end: give a worker's memory back, which later tasks of other operators would else add to."""
    for cache in caches:
        cache.clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like `names` that df has not, in whatever case."""
    taken = {c.lower() for c in df.columns}
    return [next(x for x in (name, *(f"{name}_{k}" for k in range(len(taken) + 1))) if x.lower() not in taken) for name in names]


def text_or_empty(text_col: str) -> Column:
    return F.coalesce(F.col(f"`{text_col}`"), F.lit(""))


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id long, text string), null text as empty; whatever else docs holds is not read."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_or_empty(text_col).cast("string").alias("text"))


#: Bits of a sieve: 8 MB, whatever the number of keys.
SIEVE_BITS = 1 << 26
_BITMAP = 1 << 15


def sieved(df: DataFrame, key: Column, keys: DataFrame, key_col: str) -> DataFrame:
    """Rows of df whose key may be one of `keys`: all of those, and few others while the keys are few.

    It spares a join by key the exchange of rows that have no partner, and changes nothing
    else. What is broadcast is a bitmap of fixed size; the more keys, the more others pass.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(SIEVE_BITS).cast("long"))
    bucket, bits, at = fresh(df, "bucket", "bits", "at")
    # dealt before they are combined, as bitmaps are larger than their rows
    places = keys.select(place(F.col(key_col)).alias(at)).select(F.floor(F.col(at) / _BITMAP).cast("int").alias(bucket), (F.col(at) % _BITMAP).alias(at)).repartition(bucket)
    bitmaps = materialize(places.groupBy(bucket).agg(F.bitmap_construct_agg(at).alias(bits)), "sieve", 1)
    own = [F.col(f"`{c}`") for c in df.columns]
    placed = df.select(*own, place(key).alias(at)).withColumn(bucket, F.floor(F.col(at) / _BITMAP).cast("int"))
    byte = F.conv(F.hex(F.substring(F.col(bits), (F.floor(F.col(at) % _BITMAP / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    met = placed.join(F.broadcast(bitmaps), bucket)
    return met.where(F.getbit(byte, (F.col(at) % 8).cast("int")) == 1).select(*own)
