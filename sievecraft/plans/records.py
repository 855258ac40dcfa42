"""Queries of the record codecs, banks and features: records are made from the parts' numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..audio import features
from ..functions import codecs, expr
from ..sources import banks, tables
from .registry import Registry, read

registry = Registry()
query = registry.query


def _params(spark: SparkSession, sf: str, legal: bool = True) -> DataFrame:
    """id, name, params: 155 parameters of each part, in their legal ranges or somewhat beyond."""
    part = read(spark, sf, "part")
    spread = [hi - lo + (1 if legal else 12) for lo, hi in codecs.RANGES]
    low = [lo for lo, _ in codecs.RANGES]
    value = F.zip_with(
        F.zip_with(F.sequence(F.lit(1), F.lit(codecs.UNPACKED)), F.array(*[F.lit(s) for s in spread]), lambda i, s: F.pmod(F.col("p_partkey") * 31 + i * 17 + F.floor(F.col("p_partkey") / 7) * i, s).cast("int")),
        F.array(*[F.lit(x) for x in low]),
        lambda v, lo: v + lo,
    )
    return part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), value.alias("params"))


_PARAMS = f"""spread AS (SELECT unnest(range(1, 156)) AS i, unnest([{', '.join(str(hi - lo + 1) for lo, hi in codecs.RANGES)}]) AS s, unnest([{', '.join(str(hi - lo + 12) for lo, hi in codecs.RANGES)}]) AS w,
        unnest([{', '.join(str(lo) for lo, _ in codecs.RANGES)}]) AS lo, unnest([{', '.join(str(hi) for _, hi in codecs.RANGES)}]) AS hi),
    p AS (SELECT p_partkey AS id, i, lo, hi, lo + (p_partkey * 31 + i * 17 + (p_partkey // 7) * i) % s AS v, lo + (p_partkey * 31 + i * 17 + (p_partkey // 7) * i) % w AS x FROM part, spread)"""


@query("SELECT p_partkey AS id, true AS same, CAST(128 AS INTEGER) AS size FROM part")
def pack_unpack_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    packed = _params(spark, sf).withColumn("packed", codecs.pack(F.col("params")))
    return packed.select("id", (codecs.unpack(F.col("packed")) == F.col("params")).alias("same"), F.octet_length("packed").alias("size"))


@query(f"WITH {_PARAMS} SELECT id, CAST(sum(least(greatest(x, lo), hi) * i) AS BIGINT) AS digest, CAST(count(*) FILTER (x > hi OR x < lo) AS INTEGER) AS clamped FROM p GROUP BY id")
def clamp_records(spark: SparkSession, sf: str) -> DataFrame:
    r = _params(spark, sf, legal=False)
    c = codecs.clamp(F.col("params"))
    digest = F.aggregate(F.zip_with(c, F.sequence(F.lit(1), F.lit(codecs.UNPACKED)), lambda v, i: (v * i).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return r.select("id", digest.alias("digest"), codecs.clamped_count(F.col("params")).alias("clamped"))


@query(f"""WITH {_PARAMS}, n AS (SELECT id, rtrim(string_agg(chr(CAST(CASE WHEN v & 127 BETWEEN 32 AND 126 THEN v & 127 ELSE 32 END AS INTEGER)), '' ORDER BY i), ' ') AS name FROM p WHERE i > 145 GROUP BY id)
    SELECT id, name, rpad(substr(p_name, 1, 10), 10, ' ') AS encoded FROM n JOIN part ON id = p_partkey""")
def record_names(spark: SparkSession, sf: str) -> DataFrame:
    r = _params(spark, sf)
    back = codecs.from_byte_array(codecs.encode_name(F.col("name")))
    return r.select("id", codecs.decode_name(F.slice("params", 146, 10)).alias("name"), F.decode(back, "utf-8").alias("encoded"))


@query()
def bank_bytes_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """All parts' records written as banks of 32, and parsed and normalised again."""
    r = _params(spark, sf).select("id", codecs.pack(F.col("params")).alias("packed"))
    files = banks.to_banks(banks.number(r, "id"), bytes(codecs.PACKED)).select(F.format_string("bank%05d.syx", "bank").alias("path"), "content")
    return banks.normalise(banks.parse_banks(files)).select("file", "slot", "name", "clamped_bytes", "reason", F.sha2("packed", 256).alias("digest"))


@query("SELECT p_partkey AS id, CAST(178 AS INTEGER) AS size, true AS same FROM part")
def seven_bit_frames(spark: SparkSession, sf: str) -> DataFrame:
    data = codecs.from_byte_array(F.col("params"))
    r = _params(spark, sf).select("id", data.alias("data")).withColumn("frame", codecs.pack7_udf("data"))
    return r.select("id", F.octet_length("frame").alias("size"), (codecs.unpack7_udf("frame") == F.col("data")).alias("same"))


_ACTIVE = f"""{_PARAMS}, o AS (SELECT id, (i - 1) // 21 AS k, max(v) FILTER ((i - 1) % 21 = 16) AS level, max(v) FILTER ((i - 1) % 21 = 17) AS mode, max(v) FILTER ((i - 1) % 21 = 18) AS coarse, max(v) FILTER ((i - 1) % 21 = 19) AS fine,
        max(v) FILTER ((i - 1) % 21 = 20) AS detune, max(v) FILTER ((i - 1) % 21 = 9) + max(v) FILTER ((i - 1) % 21 = 10) AS scaling, max(v) FILTER ((i - 1) % 21 = 15) AS vel FROM p WHERE i <= 126 GROUP BY 1, 2),
    r AS (SELECT *, CASE WHEN coarse = 0 THEN 0.5e0 ELSE CAST(coarse AS DOUBLE) END * (1 + fine / 100.0e0) AS ratio FROM o),
    f AS (SELECT id, count(*) FILTER (level > 0) AS active, count(*) FILTER (level > 0 AND mode = 1) AS fixed, coalesce(max(log2(ratio)) FILTER (level > 0 AND mode <> 1), 0.0) AS max_ratio,
        coalesce(stddev_pop(detune) FILTER (level > 0), 0.0) AS detune, sum(scaling) / 6.0e0 AS scaling, sum(vel) / 6.0e0 AS vel,
        CASE WHEN count(*) FILTER (level > 0 AND mode <> 1) > 0 THEN count(*) FILTER (level > 0 AND mode <> 1 AND (floor(ratio + 0.5) < 1 OR abs(ratio - floor(ratio + 0.5)) > 0.02)) / CAST(count(*) FILTER (level > 0 AND mode <> 1) AS DOUBLE) ELSE 0.0 END AS odd
        FROM r GROUP BY id)"""


@query(f"WITH {_ACTIVE} SELECT id, CAST(active AS INTEGER) AS active, CAST(fixed AS INTEGER) AS fixed, round(max_ratio, 6) AS max_ratio, round(detune, 6) AS detune, round(scaling, 6) AS scaling, round(vel, 6) AS vel, round(odd, 6) AS odd FROM f")
def structural_features(spark: SparkSession, sf: str) -> DataFrame:
    made = features.structural(_params(spark, sf))
    r6 = lambda n: F.round(F.col(f"structural.{n}").cast("double"), 6)
    return made.select(
        "id", F.col("structural.activeOps").alias("active"), F.col("structural.fixedOps").alias("fixed"), r6("maxRatio").alias("max_ratio"), r6("detuneSpread").alias("detune"), r6("keyScaling").alias("scaling"), r6("velSensParam").alias("vel"), r6("nonInteger").alias("odd")
    )


@query()
def structural_vector(spark: SparkSession, sf: str) -> DataFrame:
    made = features.structural(_params(spark, sf))
    return made.select("id", expr.feature_vector([F.col(f"structural.{n}") for n in features.STRUCTURAL]).alias("vector"), features.fundamental_semitones(F.col("params")).alias("lowest"))


@query()
def share_links(spark: SparkSession, sf: str) -> DataFrame:
    r = _params(spark, sf).select("id", "name", codecs.pack(F.col("params")).alias("packed")).withColumn("link", codecs.encode_link(F.col("packed"), F.col("name")))
    return r.select("id", "link", (codecs.decode_link(F.col("link")) == F.col("packed")).alias("same"), codecs.decode_link(F.concat("link", F.lit("A"))).isNull().alias("refused"))


@query("SELECT doc_id FROM documents WHERE n_chars >= 400 AND doc_id % 3 <> 1")
def usable_features(spark: SparkSession, sf: str) -> DataFrame:
    """Rows whose vector has the right length and version."""
    d = read(spark, sf, "documents")
    f = d.select(F.col("doc_id").alias("voice_id"), F.when(F.col("doc_id") % 3 != 1, 2).alias("analysis_version"), F.array_repeat(F.lit(0.0), F.when(F.col("n_chars") >= 400, 61).otherwise(45)).alias("vector"))
    return tables.usable_features(f).select(F.col("voice_id").alias("doc_id"))


@query("""SELECT event_id, strftime(make_timestamp(1980 + (event_id % 40), 1 + event_id % 12, 1 + event_id % 28, event_id % 24, event_id % 60, CAST((event_id % 30) * 2 AS DOUBLE)), '%Y-%m-%d %H:%M:%S') AS at FROM events""")
def dos_dates(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    date = (e % 40) * 512 + (1 + e % 12) * 32 + 1 + e % 28
    time = (e % 24) * 2048 + (e % 60) * 32 + e % 30
    return read(spark, sf, "events").select("event_id", F.date_format(codecs.dos_timestamp(date.cast("int"), time.cast("int")), "yyyy-MM-dd HH:mm:ss").alias("at"))
