"""Session settings that the operators are written for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(master: str | None = None, name: str = "sievecraft", **more: str) -> SparkSession:
    """A session with adaptive execution; on a cluster set master, spark.checkpoint.dir and partition numbers outside."""
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 1))
    builder = SparkSession.builder.appName(name)
    if master or not os.environ.get("SPARK_MASTER"):
        builder = builder.master(master or f"local[{cpus}]")
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.driver.memory": "16g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | more
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
