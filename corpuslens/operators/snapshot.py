"""Snapshot diff and cascading upsert of the index relations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILE = ["root_path", "file_path"]
# The column of each relation that names the file a row belongs to.
OWNER = {
    "files": "file_path", "symbols": "file_path", "imports": "file_path", "identifiers": "file_path",
    "deps": "importer_file", "callsites": "caller_file",
}


def moved(disk: DataFrame, index: DataFrame) -> DataFrame:
    """Rows of ``disk`` whose (time, size) the index does not have: the only ones worth hashing."""
    stat = index.select(*FILE, "mtime_ns", "size_bytes")
    return disk.join(stat, [*FILE, "mtime_ns", "size_bytes"], "left_anti").select(*disk.columns)


def diff_snapshots(disk: DataFrame, index: DataFrame, hashes: DataFrame | None = None) -> DataFrame:
    """Class of every path on either side: missing, changed, touched, current or removed.

    ``disk(root_path, file_path, mtime_ns, size_bytes)`` against the files relation.
    Equal time and size mean current without a look at the hash. Hashes come from
    ``disk.content_hash`` or from ``hashes(root_path, file_path, content_hash)`` for the
    :func:`moved` rows. ``touched`` files moved but kept their hash. Only keys and stat
    columns are shuffled, never text.
    """
    was = index.select(
        *FILE, F.col("mtime_ns").alias("_m"), F.col("size_bytes").alias("_s"), F.col("content_hash").alias("_h")
    )
    keys = [*FILE, "mtime_ns", "size_bytes"]
    now = disk.select(*keys, "content_hash") if hashes is None else disk.select(*keys).join(hashes, FILE, "left")
    both = now.withColumn("_now", F.lit(True)).join(was.withColumn("_was", F.lit(True)), FILE, "full_outer")
    same_stat = (F.col("mtime_ns") == F.col("_m")) & (F.col("size_bytes") == F.col("_s"))
    status = (
        F.when(F.col("_was").isNull(), "missing")
        .when(F.col("_now").isNull(), "removed")
        .when(same_stat, "current")
        .when(F.col("content_hash") == F.col("_h"), "touched")
        .otherwise("changed")
    )
    return both.select(*FILE, status.alias("status"))


def stale(diff: DataFrame) -> DataFrame:
    """Files to extract again."""
    return diff.where(F.col("status").isin("missing", "changed")).select(*FILE)


def evicted(diff: DataFrame) -> DataFrame:
    """Files whose old rows go: the changed and the removed."""
    return diff.where(F.col("status").isin("changed", "removed")).select(*FILE)


def upsert(old: DataFrame, new: DataFrame, gone: DataFrame, owner: str = "file_path") -> DataFrame:
    """``old`` without the rows of ``gone(root_path, file_path)`` files, plus ``new``."""
    keys = gone.select("root_path", F.col("file_path").alias(owner))
    return old.join(keys, ["root_path", owner], "left_anti").select(*new.columns).unionByName(new)
