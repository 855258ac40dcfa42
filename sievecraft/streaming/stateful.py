"""Stateful streams: reassembly of framed messages, ratings that follow results, incremental ingest, refit triggers."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import elo

MESSAGE = "port string, message binary"
START, END = 0xF0, 0xF7


def feed(buffer: bytes | None, chunk: bytes, longest: int | None = None) -> tuple[bytes | None, list[bytes]]:
    """Buffer after a chunk of bytes (None: outside a message), and the messages it ended. A start byte starts anew. longest: bytes beyond which an unfinished message is given up, if any."""
    done: list[bytes] = []
    at = 0
    while at < len(chunk):
        start, end = chunk.find(START, at), chunk.find(END, at)
        if start >= 0 and (buffer is None or end < 0 or start < end):
            buffer, at = bytes([START]), start + 1
        elif buffer is None:
            break
        elif end >= 0:
            done.append(buffer + chunk[at : end + 1])
            buffer, at = None, end + 1
        else:
            buffer, at = buffer + chunk[at:], len(chunk)
            if longest is not None and len(buffer) > longest:
                buffer = None
    return buffer, done


def reassemble(stream: DataFrame, longest: int | None = None) -> DataFrame:
    """stream: port, seq, data (chunks of bytes) -> port, message. Unfinished messages wait in the state of their port, however long they grow; longest: give them up beyond so many bytes."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        buffer = state.get[0] if state.exists else None
        rows = pd.concat(batches).sort_values("seq")
        out = []
        for chunk in rows.data:
            buffer, done = feed(buffer, bytes(chunk), longest)
            out += done
        state.update((buffer,))
        yield pd.DataFrame({"port": [key[0]] * len(out), "message": out})

    return stream.select("port", "seq", "data").groupBy("port").applyInPandasWithState(run, MESSAGE, "buffer binary", "append", GroupStateTimeout.NoTimeout)


def elo_stream(results: DataFrame) -> DataFrame:
    """results: band, seq, winner, loser -> band, id, score, games of the items that a batch touched (update mode). A band's standings are its state."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {int(k): tuple(v) for k, v in json.loads(state.get[0]).items()} if state.exists else {}
        rows = pd.concat(batches).sort_values("seq")
        held = elo.fold(list(zip(rows.winner.tolist(), rows.loser.tolist())), held)
        state.update((json.dumps(held),))
        touched = sorted(set(rows.winner) | set(rows.loser))
        yield pd.DataFrame({"band": [key[0]] * len(touched), "id": touched, "score": [held[i][0] for i in touched], "games": [held[i][1] for i in touched]})

    return results.select("band", "seq", "winner", "loser").groupBy("band").applyInPandasWithState(run, "band long, id long, score double, games long", "held string", "update", GroupStateTimeout.NoTimeout)


def incremental(compute: Callable[[DataFrame], DataFrame], target: str, key: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: rows whose key the target table lacks are computed and appended to it; a batch that is run again adds nothing."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates([key])
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            fresh = fresh.join(spark.read.parquet(target).select(key), key, "left_anti")
        compute(fresh).write.mode("append").parquet(target)

    return write


class RefitTrigger:
    """Counts judgements as batches arrive and calls fit(rated) when enough have come since the last fit."""

    def __init__(self, fit: Callable[[int], None], share: float = 0.25, least: int = 10):
        self.fit, self.share, self.least = fit, share, least
        self.since = self.at_fit = self.rated = 0

    def __call__(self, batch: DataFrame, number: int) -> None:
        """foreachBatch: batch has a row per judgement, with `new` set for items that were not rated before."""
        row = batch.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col("new").cast("int")), F.lit(0)).alias("new")).first()
        self.since += row.n
        self.rated += row.new
        if self.since and self.since >= max(self.least, int(self.share * self.at_fit + 0.5)):
            self.fit(self.rated)
            self.since, self.at_fit = 0, self.rated


def windowed_counts(stream: DataFrame, at: str = "ts", length: str = "1 hour", late: str = "10 minutes", every: str | None = None, key: str | None = None) -> DataFrame:
    """start, (key,) n, total of event-time windows; events later than `late` are dropped, so the state stays bounded."""
    events = stream.withColumn("__at", F.col(at).cast("timestamp")).withWatermark("__at", late)
    w = F.window("__at", length, every) if every else F.window("__at", length)
    return events.groupBy(w.alias("w"), *([key] if key else [])).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), *([key] if key else []), "n", "total")


def session_counts(stream: DataFrame, key: str, at: str = "ts", gap: str = "2 hours", late: str = "10 minutes") -> DataFrame:
    events = stream.withColumn("__at", F.col(at).cast("timestamp")).withWatermark("__at", late)
    return events.groupBy(F.session_window("__at", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
