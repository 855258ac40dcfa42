"""Schemas and stored tables: voices, features, ratings, settings; sessions and backups as JSON."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedupe import latest, upsert

SOURCE = "struct<file:string,bank:string,slot:int,bundle:string,device:string,name:string,container:string,checksum_ok:boolean,at:timestamp,at_from:string>"
VOICE = f"id long, packed_key binary, packed binary, unpacked binary, name string, sources array<{SOURCE}>, pinned boolean, clamped_bytes int, user_supplied boolean"
FEATURE = "voice_id long, analysis_version int, vector array<float>, category string, subcategory string, category_confidence double, silent boolean"
RATING = "voice_id long, rating int, at timestamp, pass string"
SETTING = "name string, value string, seq long"
DIM, ANALYSIS_VERSION = 61, 2


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


class Table:
    """A Parquet table that is replaced as a whole: versions lie side by side, the last complete one counts."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema

    def _versions(self) -> list[int]:
        if not _exists(self.spark, self.path):
            return []
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit() and _exists(self.spark, f"{self.path}/{n}/_SUCCESS"))

    def read(self) -> DataFrame:
        found = self._versions()
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v{found[-1]}") if found else self.spark.createDataFrame([], self.schema)

    def replace(self, df: DataFrame) -> None:
        found = self._versions()
        df.write.parquet(f"{self.path}/v{(found[-1] + 1) if found else 0}")

    def put(self, df: DataFrame, key: str) -> None:
        """Upsert: rows of df take the place of those with the same key."""
        old = self.read()
        self.replace(old.join(df.select(key), key, "left_anti").select(*old.columns).unionByName(df.select(*old.columns)))

    def clear(self) -> None:
        self.replace(self.spark.createDataFrame([], self.schema))

    def count(self) -> int:
        return self.read().count()

    def get(self, key: str, value) -> DataFrame:
        return self.read().where(F.col(key) == value)


class Settings(Table):
    """Key-value settings: JSON text by name; the last write wins."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path, SETTING)

    def all(self) -> dict:
        rows = latest(self.read(), "name", "seq", "value").where("value IS NOT NULL").collect()  # a handful of names
        return {r.name: json.loads(r.value) for r in rows}

    def set(self, name: str, value) -> None:
        n = self.read().agg(F.coalesce(F.max("seq") + 1, F.lit(0).cast("long")).alias("n")).first().n
        self.replace(self.read().unionByName(self.spark.createDataFrame([(name, None if value is None else json.dumps(value), n)], SETTING)))

    def delete(self, name: str) -> None:
        self.set(name, None)


def add_voices(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Upsert of voices by content key; see operators.dedupe.upsert. Both: packed_key, id, sources, pinned, user_supplied."""
    shape = lambda df: df.select(F.col("packed_key").alias("key"), F.col("id").alias("payload"), "sources", "pinned", "user_supplied", F.col("id").alias("seq"))
    return upsert(shape(existing), shape(incoming))


def usable_features(features: DataFrame, dim: int = DIM, version: int = ANALYSIS_VERSION) -> DataFrame:
    """Feature rows of the right length and version; rows without a version are of the first."""
    return features.where((F.size("vector") == dim) & (F.coalesce("analysis_version", F.lit(1)) == version))


def missing_features(voices: DataFrame, features: DataFrame) -> DataFrame:
    return voices.join(features.select(F.col("voice_id").alias("id")), "id", "left_anti")


def export_backup(voices: DataFrame, ratings: DataFrame, overrides: DataFrame, standings: DataFrame) -> DataFrame:
    """Judgements keyed by content, one JSON object a row: key, rating, override, pinned, score, games."""
    joined = voices.select("id", F.base64("packed_key").alias("key"), "pinned")
    for side in (ratings.select(F.col("voice_id").alias("id"), "rating"), overrides.select("id", "override"), standings.select("id", "score", "games")):
        joined = joined.join(side, "id", "left")
    kept = joined.where("rating IS NOT NULL OR override IS NOT NULL OR pinned OR games > 0")
    return kept.select(F.to_json(F.struct("key", "rating", "override", "pinned", "score", "games")).alias("value"))


BACKUP = "key string, rating int, override string, pinned boolean, score double, games long"


def import_backup(lines: DataFrame, voices: DataFrame) -> DataFrame:
    """lines: value -> the judgements with the id of the voice that has the content; null where none has."""
    parsed = lines.select(F.from_json("value", BACKUP).alias("b")).select("b.*")
    own = voices.select("id", F.base64("packed_key").alias("key"))
    return parsed.join(own, "key", "left")


def backup_summary(imported: DataFrame) -> DataFrame:
    known = F.col("id").isNotNull()
    return imported.agg(
        F.count_if(known & F.col("rating").isNotNull()).alias("ratings"), F.count_if(known & F.col("override").isNotNull()).alias("overrides"), F.count_if(known & F.coalesce("pinned", F.lit(False))).alias("pinned"), F.count_if(~known).alias("missing")
    )


def write_session(path: str, voices: DataFrame, features: DataFrame, links: DataFrame, coords: DataFrame) -> None:
    """A session as gzipped JSON lines, one folder per part; features are left out unless every voice has a usable one."""
    parts = {"voices": voices, "links": links, "coords": coords}
    usable = usable_features(features)
    if missing_features(voices, usable).limit(1).count() == 0:
        parts["features"] = usable
    for name, df in parts.items():
        df.write.option("compression", "gzip").json(f"{path}/{name}")


def read_session(spark: SparkSession, path: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    return {name: spark.read.schema(schema).json(f"{path}/{name}") for name, schema in schemas.items() if _exists(spark, f"{path}/{name}")}


def graph_usable(n_now: int, n_then: int) -> bool:
    """Links and coordinates count only for as many rows as they were made for."""
    return n_now == n_then


def fingerprint(df: DataFrame, *columns: str) -> DataFrame:
    """One row: n, digest (the same for any order of the rows)."""
    return df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64(*columns)), F.lit(0).cast("long")).alias("digest"))


def stale_reasons(now: dict, then: dict) -> list[str]:
    """Names of inputs of a build that have changed since."""
    return sorted(k for k in {*now, *then} if now.get(k) != then.get(k))


def pass_order(counts: dict[str, int]) -> str | None:
    """What to compute next: analysis, then clusters, then embedding; None when all is up to date. counts: voices, features, graph, coords."""
    if counts["features"] < counts["voices"]:
        return "analysis"
    if counts.get("graph", -1) != counts["voices"]:
        return "clusters"
    return "embedding" if counts.get("coords", -1) != counts["voices"] else None


def paged(df: DataFrame, key: str = "id", size: int = 2500):
    """Pages of a table in the order of its key, each read from a lower bound on."""
    low = None
    while True:
        part = (df if low is None else df.where(F.col(key) > low)).orderBy(key).limit(size).collect()
        if not part:
            return
        yield part
        low = part[-1][key]
