"""Session settings and the written-table lineage cut used by iterative jobs."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# Run-time SQL settings only: safe to apply to a session that somebody else made.
_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join side even when that costs another shuffle downstream.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # Files are packed: sides are chosen for broadcast by about their size as rows in memory, not on disk.
    "spark.sql.sources.fileCompressionFactor": "8.0",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the library's run-time settings to ``spark`` and return it."""
    for key, value in _SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def _local(spark: SparkSession) -> bool:
    """Whether driver and executors are on one machine: ``local[..]`` and ``local-cluster[..]``."""
    return spark.conf.get("spark.master", "").startswith("local")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for an intermediate table, under ``spark.checkpoint.dir``.

    The folder has to be shared by all executors. Only a local master may go
    without the setting; it gets a folder of its own, remembered in the session.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("corpuslens.scratch", None)
    if not base:
        if not _local(spark):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-corpuslens-", dir="/tmp")
        spark.conf.set("corpuslens.scratch", base)
    elif base.startswith("file:") and not _local(spark):
        raise ValueError("spark.checkpoint.dir is a folder of one machine; set one that all executors share")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def freeing(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of each execution inside go as soon as it has ended; for steps that are run once, as those that :func:`cut` writes."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def cut(df: DataFrame, name: str = "cut", count: Column | None = None) -> tuple[DataFrame, int]:
    """Write ``df`` as a table in the scratch folder; return it read back, and a count.

    Unlike ``checkpoint`` this computes the rows once, keeps column pruning and
    filter pushdown, and gives the next join the table's true size, so Spark
    itself decides whether a side is small enough to broadcast. A lost executor
    costs nothing: the files are in shared storage. The count (of rows, or any other
    aggregate given) rides along with the write, so loop-end tests need no job of their own.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    seen = Observation()
    counted = F.count(F.lit(1)) if count is None else count
    df.observe(seen, counted.alias("n")).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), int(seen.get["n"] or 0)
