"""Session defaults."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def automatic_workers(cpu_count: int | None = None) -> int:
    """Half the CPUs, one at least and eight at most."""
    return min(8, max(1, (cpu_count or os.cpu_count() or 1) // 2))


def session(name: str = "gridloom", cpus: int | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow; on a cluster the master and sizes come from its own settings."""
    builder = SparkSession.builder.appName(name)
    if cpus:
        builder = builder.master(f"local[{cpus}]")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", shuffle_partitions)
    settings = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.sql.mapKeyDedupPolicy": "LAST_WIN", **conf}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpointed(frame: DataFrame) -> DataFrame:
    """``frame``, computed once and kept in ``spark.checkpoint.dir``; a temporary folder stands in for it in local mode only."""
    spark = frame.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(base or tempfile.mkdtemp(prefix="gridloom-"))
    return frame.checkpoint()
