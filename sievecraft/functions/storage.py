"""Tables in the folder that driver and executors share: they cut lineage and survive the loss of executors."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, as in tests, a new temporary folder, but on a cluster an error."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="sievecraft-"))  # one machine, one process
    return sc._jsc.sc().getCheckpointDir().get()


FILE_BYTES = 64 << 20


def files_for(rows: int, row_bytes: int) -> int:
    """How many files hold so many rows at a good size."""
    return max(1, -(-rows * row_bytes // FILE_BYTES))


def materialize(df: DataFrame, label: str, files: int | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again. files: deal the rows to so many files, where a task each would make many small ones."""
    spark = df.sparkSession
    if files:
        df = df.repartition(files)
    path = f"{shared_dir(spark)}/sievecraft/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def discard(*tables: DataFrame | None) -> None:
    """Delete tables of materialize() that nothing reads any more; other frames are left alone."""
    paths = {getattr(t, "_stored_at", None) for t in tables} - {None}
    for spark, path in [w for w in _written if w[1] in paths]:
        _written.remove((spark, path))
        _delete(spark, path)


def written() -> int:
    """How many tables stand now: a mark for release()."""
    return len(_written)


def release(since: int = 0, keep: DataFrame | None = None) -> None:
    """Delete the tables that materialize() wrote in this process (after the mark `since`), but not keep's."""
    kept = [w for w in _written[since:] if keep is not None and w[1] == getattr(keep, "_stored_at", None)]
    for spark, path in _written[since:]:
        if (spark, path) not in kept:
            _delete(spark, path)
    _written[since:] = kept


atexit.register(release)
