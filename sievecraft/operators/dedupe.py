"""Exact dedupe, upsert with merged provenance, and summaries of what came in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exact_dedupe(df: DataFrame, key: Column, id_col: str, seq_col: str) -> DataFrame:
    """One row per key: rep (the id of the first by seq), first_seq, copies. Rows with a null key are one group."""
    return df.withColumn("__key", key).groupBy("__key").agg(
        F.min_by(id_col, seq_col).alias("rep"), F.min(seq_col).alias("first_seq"), F.count(F.lit(1)).alias("copies")
    ).drop("__key")


def members(df: DataFrame, key: Column, id_col: str, seq_col: str) -> DataFrame:
    """Every row's representative: id, rep, copies; groups are never gathered into one row."""
    keyed = df.select(key.alias("__key"), F.col(id_col).alias("id"), F.col(seq_col).alias("seq"))
    heads = keyed.groupBy("__key").agg(F.min_by("id", "seq").alias("rep"), F.count(F.lit(1)).alias("copies"))
    return keyed.join(heads, keyed["__key"].eqNullSafe(heads["__key"])).select("id", "rep", "copies")


def upsert(existing: DataFrame, incoming: DataFrame, seq_col: str = "seq") -> DataFrame:
    """existing and incoming: key, payload, sources (array of structs with file, bank, slot), pinned, user_supplied, and seq.

    New keys are inserted; a known key keeps its first payload, appends sources that it does
    not have yet (by file, bank and slot, in order of arrival) and ORs its flags. A record
    that carries one source twice keeps both. Returns key, payload, sources, pinned,
    user_supplied, is_new, merged (records merged into it).
    """
    both = existing.withColumn("__old", F.lit(True)).withColumn("__at", F.struct(F.lit(0).alias("o"), F.col(seq_col).cast("long").alias("s"))).unionByName(
        incoming.withColumn("__old", F.lit(False)).withColumn("__at", F.struct(F.lit(1).alias("o"), F.col(seq_col).cast("long").alias("s")))
    )
    ident = lambda s: F.struct(s["file"], s["bank"], s["slot"])
    grouped = both.groupBy("key").agg(
        F.min_by("payload", "__at").alias("payload"),
        F.array_sort(F.collect_list(F.struct("__at", "sources"))).alias("arrivals"),
        F.max("pinned").alias("pinned"),
        F.max("user_supplied").alias("user_supplied"),
        (~F.max("__old")).alias("is_new"),
        (F.count(F.lit(1)) - 1).alias("merged"),
    )
    append = lambda acc, a: F.concat(acc, F.filter(a["sources"], lambda s: ~F.exists(acc, lambda x: ident(x) == ident(s))))
    first = F.element_at("arrivals", 1)["sources"]
    rest = F.slice("arrivals", 2, F.greatest(F.size("arrivals") - 1, F.lit(0)))
    return grouped.select("key", "payload", F.aggregate(rest, first, append).alias("sources"), "pinned", "user_supplied", "is_new", "merged")


def insert_synthesised(existing: DataFrame, new: DataFrame, key: str = "key") -> DataFrame:
    """existing with the rows of new whose key it lacks; a known key is pinned instead."""
    known = existing.join(new.select(key).distinct().withColumn("__again", F.lit(True)), key, "left")
    known = known.withColumn("pinned", F.col("pinned") | F.coalesce("__again", F.lit(False))).drop("__again")
    return known.unionByName(new.join(existing.select(key), key, "left_anti").dropDuplicates([key]))


def provenance(sources: DataFrame) -> DataFrame:
    """sources: name, file, slot, at. One row per (name, file), the earliest date first: slots (sorted, with repeats), since."""
    return sources.groupBy("name", "file").agg(F.array_sort(F.collect_list("slot")).alias("slots"), F.min("at").alias("since"))


def ingest_summary(records: DataFrame) -> DataFrame:
    """records: reason (null: taken). reason, n."""
    return records.groupBy(F.coalesce("reason", F.lit("taken")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def latest(events: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """The last event of each key (by time, then by tie); an event log's current state."""
    rest = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(at, tie)).alias("__last")).select(key, *[F.col(f"__last.{c}").alias(c) for c in rest])


def point_update(df: DataFrame, changes: DataFrame, key: str, column: str) -> DataFrame:
    """df with column replaced where changes (key, value, clear) has the key; clear sets null."""
    joined = df.join(changes.select(key, F.col("value").alias("__value"), F.col("clear").alias("__clear")), key, "left")
    new = F.when(F.coalesce("__clear", F.lit(False)), F.lit(None)).otherwise(F.coalesce("__value", F.col(column)))
    return joined.withColumn(column, new).drop("__value", "__clear")


def restore(backup: DataFrame, corpus: DataFrame, key: str = "key") -> DataFrame:
    """Judgements of a backup with the id that their content has in the corpus; null where it is missing."""
    return backup.join(corpus.select(key, F.col("id")), key, "left")


def replace_named(manifest: DataFrame, new: DataFrame, name: str = "name") -> DataFrame:
    """manifest with the entries of new, which replace those of the same name."""
    return manifest.join(new.select(name), name, "left_anti").unionByName(new)
