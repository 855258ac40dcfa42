"""Whole jobs: a folder of files to families, and judgements to banks. Each step writes a table and can be run again."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..audio import features
from ..functions import codecs
from ..functions.storage import materialize
from ..operators import allocate, category, dedupe, families, neighbours, sequence, vectors
from ..sources import banks, files, tables

VOICES = f"id long, packed_key binary, packed binary, name string, sources array<{tables.SOURCE}>, pinned boolean, user_supplied boolean"
FEATURES = "id long, version int, vector array<double>, silent boolean"


@dataclass
class Store:
    spark: SparkSession
    path: str

    def table(self, name: str, schema: str) -> tables.Table:
        return tables.Table(self.spark, f"{self.path}/{name}", schema)

    @property
    def voices(self) -> tables.Table:
        return self.table("voices", VOICES)

    @property
    def features(self) -> tables.Table:
        return self.table("features", FEATURES)


def ingest(store: Store, folder: str, bundle: str | None = None, init: bytes | None = None) -> DataFrame:
    """Files and archives under a folder into the voices table; returns the tally of reasons."""
    found = files.scan_files(store.spark, folder, inside_folder=False).select("path", "length", "content")
    zipped = files.open_zips(found.where(F.lower("path").endswith(".zip")))
    plain = found.where(~F.lower("path").endswith(".zip") & files.looks_like_bank(F.col("path"), F.col("length"))).select("path", "content")
    entries = zipped.where("error IS NULL").select(F.concat_ws("/", "archive", "entry").alias("path"), "content")
    parsed = banks.parse_banks(plain.unionByName(entries))
    records = banks.normalise(parsed, init)
    tally = dedupe.ingest_summary(records.select("reason").unionByName(parsed.where("skipped IS NOT NULL").select(F.col("skipped").alias("reason"))).unionByName(zipped.where("error IS NOT NULL").select(F.lit("unreadable").alias("reason"))))
    source = F.struct(
        "file", "bank", "slot", F.lit(bundle).alias("bundle"), F.lit(None).cast("string").alias("device"), "name", "container", "checksum_ok", F.lit(None).cast("timestamp").alias("at"), F.lit(None).cast("string").alias("at_from")
    )
    old = store.voices.read()
    # identity follows from content: the same record gets the same id in any run
    fresh = records.where("reason IS NULL").select(F.col("key").alias("packed_key"), "packed", "name", F.array(source).alias("sources"), F.struct("file", "bank", "slot").alias("order"))
    arrived = fresh.withColumn("seq", F.row_number().over(Window.partitionBy("packed_key").orderBy("order")).cast("long"))
    shape = lambda df, seq: df.select(F.col("packed_key").alias("key"), F.struct("packed", "name").alias("payload"), "sources", F.lit(False).alias("pinned"), F.lit(bundle is None).alias("user_supplied"), seq.alias("seq"))
    known = old.select(F.col("packed_key").alias("key"), F.struct("packed", "name").alias("payload"), "sources", "pinned", "user_supplied", F.lit(0).cast("long").alias("seq"))
    merged = dedupe.upsert(known, shape(arrived, F.col("seq")))
    identity = F.xxhash64("key").bitwiseAND(F.lit((1 << 62) - 1))
    store.voices.replace(merged.select(identity.alias("id"), F.col("key").alias("packed_key"), "payload.packed", "payload.name", "sources", "pinned", "user_supplied"))
    return tally


def analyse(store: Store, rate: int = 22050) -> int:
    """Features of voices that have none of this version yet; returns how many were computed."""
    voices, old = store.voices.read(), store.features.read().where(F.col("version") == features.VERSION)
    missing = voices.join(old.select("id"), "id", "left_anti").select("id", codecs.unpack(F.col("packed")).alias("params"))
    n = missing.count()
    if n:
        # rendering is the cost, so rows are dealt evenly to all cores
        new = features.extract(missing.repartition(max(1, min(n, store.spark.sparkContext.defaultParallelism))), rate=rate)
        store.features.replace(old.select("id", "version", "vector", "silent").unionByName(new.select("id", "version", "vector", "silent")))
    return n


def space(store: Store) -> DataFrame:
    """id, v: standardised and whitened features."""
    rows = store.features.read().select("id", F.col("vector").alias("v"))
    st = vectors.Standardizer.fit(rows, weight=features.WEIGHTS)
    flat = rows.select("id", st.apply(F.col("v")).alias("v"))
    return vectors.whitener(vectors.collect_moments(flat, len(features.NAMES))[0]).apply(flat, into="w").select("id", F.col("w").alias("v"))


def cluster(store: Store, family: float = 0.30, merge: float = 0.16, most: float = 0.4) -> DataFrame:
    """id, merged, family: near-duplicate families in the whitened space, distances relative to the median one."""
    rows = space(store)
    voices = store.voices.read().select("id", codecs.unpack(F.col("packed")).alias("params"))
    both = rows.join(voices, "id").withColumn("p", F.slice("params", 1, codecs.NAME_AT))
    blocked = neighbours.kmeans_blocks(both.select("id", "v", "p"))
    scale, span = calibrate(both), [max(1.0, float(hi - lo)) for lo, hi in codecs.RANGES[: codecs.NAME_AT]]
    links = neighbours.near_links(blocked, most, blocks="blocks", scale=scale[0], weights=(0.6, 0.4), params="p", param_scale=scale[1], ranges=span)
    return families.two_levels(rows, links, family, merge)


def calibrate(rows: DataFrame, pairs: int = 20_000) -> tuple[float, float]:
    """Medians of both distances over pairs of rows that are neighbours in a hashed order, at most about `pairs`."""
    n = rows.count()
    part = rows if n <= pairs else rows.where(F.pmod(F.xxhash64("id"), F.lit(n)) < pairs)  # a sample of distances, not of results
    order = Window.partitionBy(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(64))).orderBy(F.xxhash64("id", F.lit(2)), "id")
    span = F.array(*[F.lit(max(1.0, float(hi - lo))) for lo, hi in codecs.RANGES[: codecs.NAME_AT]])
    next_ = part.select("id", "v", "p", F.lead("v").over(order).alias("v2"), F.lead("p").over(order).alias("p2")).where("v2 IS NOT NULL")
    d = F.sqrt(F.aggregate(F.zip_with("v", "v2", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    far = F.zip_with(F.zip_with("p", "p2", lambda a, b: F.abs(a - b).cast("double")), span, lambda a, b: a / b)
    row = next_.select(d.alias("d"), (F.aggregate(far, F.lit(0.0), lambda s, x: s + x) / codecs.NAME_AT).alias("p")).agg(F.percentile("d", 0.5).alias("d"), F.percentile("p", 0.5).alias("p")).first()
    return tuple(x if x and x > 1e-9 else 1.0 for x in (row.d, row.p))


def categories(store: Store) -> DataFrame:
    """id, category, subcategory, confidence from the stored features and names."""
    at = {n: i for i, n in enumerate(features.NAMES)}
    named = {"attack": "attack", "release": "release", "sustain": "sustain", "centroid": "brightness", "abs_bright": "absBrightness", "register": "register", "inharm": "inharmonicity", "slope": "brightnessSlope", "vel_bright": "velBrightness", "vel_level": "velLevel", "key_level": "keyLevel", "flatness": "flatness", "pitch_eg": "pitchEg", "lfo_pm": "lfoPm", "lfo_am": "lfoAm", "sample_hold": "lfoSampleHold", "carriers": "carriers"}
    rows = store.features.read().join(store.voices.read().select("id", "name", codecs.unpack(F.col("packed")).alias("params")), "id")
    wide = rows.select("id", "name", *[F.element_at("vector", at[n] + 1).alias(c) for c, n in named.items()], (F.element_at("params", 145) - 24).alias("transpose"))
    scored = category.categorize(wide)
    return scored.select("id", "category", category.subcategory(F.col("category"), F.col("name")).alias("subcategory"), "confidence")


def build(store: Store, judgements: DataFrame, target: str, placeholder: bytes, total: int = allocate.TOTAL, weight: float = 6.0) -> list[str]:
    """judgements: id, rating, pinned, tie_break. Allocates, orders and writes bank files under target; returns what verification found."""
    spark = store.spark
    # written out: the scorer's large expression would be copied into every filter on its result
    kinds = materialize(categories(store).select("id", "category"), "categories")
    places = materialize(space(store), "space")
    chosen = allocate.allocate(judgements.join(kinds, "id"), total).selected
    rank = F.array_position(F.array(*[F.lit(c) for c in category.CATEGORIES]), F.col("category")).cast("int")
    run = F.when(F.col("pinned"), 0).when(F.col("backfilled"), 2).otherwise(1)
    ordered = sequence.seriate_runs(chosen.join(places, "id").select(run.alias("run"), "id", rank.alias("category"), "v"), weight=weight)
    positions = banks.number(ordered, "run", "position").select("id", F.col("position").alias("place"))  # at most `total` rows
    records = positions.join(store.voices.read().select("id", "packed"), "id").select(F.col("place").alias("position"), "packed")
    made = banks.to_banks(records, placeholder)
    made.write.mode("overwrite").parquet(f"{target}/banks")
    faults = []
    want = {r.position: bytes(r.packed) for r in records.collect()}  # at most `total` records
    for r in spark.read.parquet(f"{target}/banks").orderBy("bank").collect():
        faults += [f"bank {r.bank}: {f}" for f in banks.verify_bank(bytes(r.content), [want.get(r.bank * 32 + s, placeholder) for s in range(32)])]
    return faults


def export_all(store: Store, init: bytes) -> DataFrame:
    """bank, content: all unique voices in banks of 32, the last padded with init records; the export is their contents in order."""
    return banks.to_banks(banks.number(store.voices.read().select("id", "packed"), "id"), init)
