"""Structured Streaming forms of the incremental parts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslens.session import scratch_path
from corpuslens.sources.records import parse_logs

FILE = ["root_path", "file_path"]


def parquet_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table, one file or a folder of files, as a file stream; new files would be picked up."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    # A pattern names files and folders alike; a stream takes no plain path of a single file.
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}*.parquet")


def last_activity(conversations: DataFrame) -> DataFrame:
    """Running last activity per package; the state is one row per package."""
    return conversations.groupBy("package_id").agg(F.max("created_at").alias("last_activity"))


def outcomes(raw: DataFrame) -> DataFrame:
    """Log documents (column ``raw``) parsed and classified, row by row."""
    return parse_logs(raw)


def drain(stream: DataFrame, mode: str, keys: list[str] | None = None) -> DataFrame:
    """Run a stream over what there is now, into tables; the last row per key in update mode.

    Every batch goes to a folder of its own name, so a batch that is run
    again after a failure overwrites itself.
    """
    spark = stream.sparkSession
    out, check = scratch_path(spark, "drained"), scratch_path(spark, "stream")

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    run = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", check)
        .trigger(availableNow=True).foreachBatch(save).start()
    )
    run.awaitTermination()
    stored = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
    rows = spark.read.schema(stored).parquet(out)
    if mode != "update":
        return rows.drop("batch")
    value = F.struct(*[c for c in rows.columns if c not in (*keys, "batch")])
    return rows.groupBy(*keys).agg(F.max_by(value, "batch").alias("_v")).select(*keys, "_v.*")


def start_index(
    files: DataFrame, extract: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, trigger: dict | None = None
):
    """Keep an extracted relation current from a stream of file rows, per micro-batch.

    Batches are appended as they come with their number; of a file that arrives again
    only the rows of its last batch count (see :func:`current`). A batch that runs twice
    overwrites its own folder, so the result does not change. Of versions within one
    batch the one with the greatest ``mtime_ns`` wins (of equal times the greatest hash): versions are
    extracted under a path that carries the hash, and only their rows are compared, so text is not shuffled. A stream
    cannot see deletions; the batch diff does. ``trigger`` is as for ``DataStreamWriter.trigger``; by default what there is now is taken in.
    """
    tag = "\u0001"

    def save(batch: DataFrame, batch_id: int) -> None:
        digest = F.sha2(F.col("content").cast("binary"), 256)
        keyed = batch.withColumn("_hash", digest)
        newest = keyed.groupBy(*FILE).agg(F.max(F.struct("mtime_ns", "_hash"))["_hash"].alias("_hash"))
        newest.select(*FILE).write.mode("overwrite").parquet(f"{path}/arrivals/batch={batch_id}")
        tagged = keyed.withColumn("file_path", F.concat_ws(tag, "file_path", "_hash")).drop("_hash")
        rows = extract(tagged)
        split = rows.withColumn("_hash", F.substring_index("file_path", tag, -1)).withColumn(
            "file_path", F.substring_index("file_path", tag, 1)
        )
        split.join(newest, [*FILE, "_hash"], "left_semi").select(*rows.columns).write.mode("overwrite").parquet(
            f"{path}/rows/batch={batch_id}"
        )

    return (
        files.writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).foreachBatch(save).start()
    )


def current(spark: SparkSession, path: str) -> DataFrame:
    """Rows of each file's last batch."""
    arrivals = spark.read.parquet(f"{path}/arrivals")
    last = arrivals.groupBy(*FILE).agg(F.max("batch").alias("batch"))
    return spark.read.parquet(f"{path}/rows").join(last, [*FILE, "batch"], "left_semi").drop("batch")


def index_stream(files: DataFrame, extract: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """:func:`start_index` into the scratch folder, drained once."""
    spark = files.sparkSession
    path = scratch_path(spark, "stream-index")
    start_index(files, extract, path, scratch_path(spark, "stream")).awaitTermination()
    return current(spark, path)
