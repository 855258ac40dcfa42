"""Queries of the streaming operators: each runs its stream over the whole table until all input is read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import shared_dir
from ..operators import elo
from ..streaming import stateful
from .registry import Registry, read

registry = Registry()
query = registry.query


def _drain(spark: SparkSession, out: DataFrame, mode: str) -> DataFrame:
    """Run a stream over what there is, and read what it wrote."""
    base = f"{shared_dir(spark)}/sievecraft/stream-{uuid.uuid4().hex}"
    if mode == "append":
        q = out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start()
    else:
        keep = lambda batch, n: batch.withColumn("__batch", F.lit(n)).write.mode("append").parquet(f"{base}/out")
        q = out.writeStream.foreachBatch(keep).option("checkpointLocation", f"{base}/state").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{base}/out") if mode == "append" else spark.read.parquet(f"{base}/out")


def _events(spark: SparkSession, sf: str) -> DataFrame:
    schema = read(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf) if not _is_folder(spark, f"{sf}/events.parquet") else spark.readStream.schema(schema).parquet(f"{sf}/events.parquet")


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


@query("""SELECT strftime(time_bucket(INTERVAL 1 hour, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events
    GROUP BY time_bucket(INTERVAL 1 hour, ts), event_type HAVING time_bucket(INTERVAL 1 hour, ts) + INTERVAL 1 hour <= (SELECT max(ts) - INTERVAL 10 minutes FROM events)""")
def stream_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    """Windows that the watermark has closed."""
    out = _drain(spark, stateful.windowed_counts(_events(spark, sf), key="event_type"), "append")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 2 hours THEN 0 ELSE 1 END AS new FROM events),
    s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
    SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts) + INTERVAL 2 hours) AS end_us, count(*) AS n FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 2 hours <= (SELECT max(ts) - INTERVAL 10 minutes FROM events)""")
def stream_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions that the watermark has closed."""
    out = _drain(spark, stateful.session_counts(_events(spark, sf), "user_id"), "append")
    return out.select("user_id", F.unix_micros(F.col("start").cast("timestamp")).alias("start_us"), F.unix_micros(F.col("end").cast("timestamp")).alias("end_us"), "n")


@query()
def stream_elo(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf).where("user_id <> event_id % 150")
    r = e.select((F.col("event_id") % 4).alias("band"), F.col("event_id").alias("seq"), F.col("user_id").alias("winner"), (F.col("event_id") % 150).alias("loser"))
    out = _drain(spark, stateful.elo_stream(r), "update")
    return out.groupBy("band", "id").agg(F.max_by(F.struct("score", "games"), "__batch").alias("s")).select("band", "id", "s.score", "s.games")


@query("""WITH b AS (SELECT user_id, count(*) AS n FROM events WHERE event_type IN ('click', 'view') GROUP BY 1) SELECT CAST(user_id AS VARCHAR) AS port, n AS messages FROM b""")
def stream_reassembly(spark: SparkSession, sf: str) -> DataFrame:
    """Every click and view ends a message that other events' bytes fill."""
    framed = F.when(F.col("event_type").isin("click", "view"), F.unhex(F.lit("F00102F7"))).otherwise(F.unhex(F.lit("0304")))
    s = _events(spark, sf).select(F.col("user_id").cast("string").alias("port"), F.col("event_id").alias("seq"), framed.alias("data"))
    return _drain(spark, stateful.reassemble(s), "append").groupBy("port").agg(F.count(F.lit(1)).alias("messages"))


@query("""WITH RECURSIVE e AS (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i, user_id FROM events),
    f AS (SELECT event_type, i, CASE WHEN row_number() OVER (PARTITION BY event_type, user_id ORDER BY i) = 1 THEN 1 ELSE 0 END AS new FROM e),
    r AS (SELECT event_type, i, sum(new) OVER (PARTITION BY event_type ORDER BY i) AS rated FROM f),
    w AS (SELECT event_type, CAST(10 AS BIGINT) AS i FROM r WHERE i = 10
        UNION ALL SELECT w.event_type, w.i + CAST(greatest(10, floor(0.25 * r.rated + 0.5)) AS BIGINT) FROM w JOIN r ON w.event_type = r.event_type AND w.i = r.i)
    SELECT w.event_type, w.i - 1 AS at FROM w JOIN r ON w.event_type = r.event_type AND w.i = r.i""")
def refit_triggers(spark: SparkSession, sf: str) -> DataFrame:
    """Which judgements (from 0, by kind) start a fit."""

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values("event_id")
        rated = (~pdf.user_id.duplicated()).cumsum()
        at = elo.refit_points(rated.tolist())
        return pd.DataFrame({"event_type": [pdf.event_type.iloc[0]] * len(at), "at": at})

    return read(spark, sf, "events").select("event_type", "event_id", "user_id").groupBy("event_type").applyInPandas(run, "event_type string, at long")
