"""Index relations as parquet, replaced all or nothing.

Each run writes the buckets it touches of all relations below folders of its own, ``relation/run=../root_path=../bucket=..``,
and then appends one file to the small table ``runs`` that says which buckets it replaced. Readers take each bucket from the
last run named there, so a run counts whole or not at all, nothing is rewritten in place and nothing deleted. A bucket
holds the rows of a share of a root's files; rows are sorted by the column lookups use, which lets row-group statistics
prune exact-name reads. One run at a time may write.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslens import schemas
from corpuslens.operators.snapshot import OWNER
from corpuslens.session import cut

SCHEMAS = {
    "files": schemas.FILES, "symbols": schemas.SYMBOLS, "imports": schemas.IMPORTS,
    "identifiers": schemas.IDENTIFIERS, "deps": schemas.DEPS, "callsites": schemas.CALLSITES,
}
SORT = {
    "files": "file_path", "symbols": "name", "imports": "target", "identifiers": "token",
    "deps": "importer_file", "callsites": "callee_name",
}
RUNS = "run string, relation string, root_path string, bucket int, buckets int"
SLOT = ["root_path", "bucket"]
BUCKET_BYTES = 1 << 30  # bytes of a root's text that a bucket stands for


def bucket_of(owner: str, buckets: int):
    return F.pmod(F.xxhash64(owner), F.lit(buckets)).cast("int")


def _there(spark: SparkSession, schema: T.StructType | str, path: str) -> DataFrame:
    """A table, empty if it was never written."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_relation(spark: SparkSession, path: str, name: str, root: str | None = None) -> DataFrame:
    """One relation as of now; an index that was never written reads as empty.

    The lists of files are taken here, those of ``runs`` first, so later runs do not change what the result reads."""
    runs = _there(spark, RUNS, f"{path}/runs").where(F.col("relation") == name)
    fields = [*SCHEMAS[name].fields, T.StructField("run", T.StringType()), T.StructField("bucket", T.IntegerType())]
    stored = _there(spark, T.StructType(fields), f"{path}/{name}")
    if root is not None:
        runs, stored = (df.where(F.col("root_path") == root) for df in (runs, stored))
    # Runs and buckets are folders, so the join also tells which of them to read.
    last = runs.groupBy(*SLOT).agg(F.max("run").alias("run"))
    return stored.join(last, [*SLOT, "run"], "left_semi").select(*SCHEMAS[name].names)


def bucket_count(spark: SparkSession, path: str, listing: DataFrame) -> int:
    """Buckets of a root: as stored with the index, and for a new one by the bytes of the largest root of ``listing``."""
    stored = _there(spark, RUNS, f"{path}/runs").agg(F.max("buckets")).first()[0]
    if stored is not None:
        return stored
    most = listing.groupBy("root_path").agg(F.sum("size_bytes").alias("n")).agg(F.max("n")).first()[0]
    return 1 + int(most or 0) // BUCKET_BYTES


def _next_run(spark: SparkSession, path: str) -> str:
    """A name that sorts after those of all runs that count, and that no failed run has used."""
    last = _there(spark, RUNS, f"{path}/runs").agg(F.max("run")).first()[0]
    return f"{int(last.split('-')[0]) + 1 if last else 1:010d}-{uuid.uuid4().hex[:12]}"


def write_relation(df: DataFrame, path: str, name: str, run: str, buckets: int) -> None:
    """Write rows of one relation below the folder of ``run``."""
    keyed = df.select(*SCHEMAS[name].names).withColumn("bucket", bucket_of(OWNER[name], buckets))
    # Spread by file, not by partition value, so that one hot root is many tasks.
    (
        keyed.repartition(*SLOT).sortWithinPartitions(*SLOT, SORT[name])
        .write.partitionBy(*SLOT).parquet(f"{path}/{name}/run={run}")
    )


def replace_files(
    spark: SparkSession, path: str, new: dict[str, tuple[DataFrame, DataFrame]], buckets: int
) -> None:
    """Replace, in each relation, all rows of the files ``gone(root_path, file_path)`` by ``rows``, all of such files.

    ``new`` is {relation: (rows, gone)}. Only buckets that hold such files are read and written again. All
    relations change at once, when the one file of ``runs`` appears.
    """
    run, marks, touched = _next_run(spark, path), [], {}
    for name, (rows, gone) in new.items():
        owner = OWNER[name]
        if id(gone) not in touched:  # most relations lose the same files
            touched[id(gone)] = cut(gone.select("root_path", bucket_of("file_path", buckets).alias("bucket")).distinct(), "slots")
        slots, n = touched[id(gone)]
        if not n:
            continue
        old = read_relation(spark, path, name).withColumn("bucket", bucket_of(owner, buckets)).join(slots, SLOT, "left_semi")
        kept = old.join(gone.select("root_path", F.col("file_path").alias(owner)), ["root_path", owner], "left_anti")
        write_relation(kept.select(*SCHEMAS[name].names).unionByName(rows.select(*SCHEMAS[name].names)), path, name, run, buckets)
        marks.append(slots.select(F.lit(run).alias("run"), F.lit(name).alias("relation"), *SLOT, F.lit(buckets).alias("buckets")))
    if marks:
        _switch(reduce(DataFrame.unionByName, marks), path)


def _switch(marks: DataFrame, path: str) -> None:
    """From here on the run counts: a file is moved to its place whole, or not at all."""
    marks.coalesce(1).write.mode("append").parquet(f"{path}/runs")


def compact(spark: SparkSession, path: str) -> None:
    """Write the whole index as one run. Folders of earlier runs are not read any more and can be deleted once no reader has them."""
    slots = _there(spark, RUNS, f"{path}/runs")
    buckets = slots.agg(F.max("buckets")).first()[0]
    if buckets is None:
        return
    run = _next_run(spark, path)
    for name in SCHEMAS:
        write_relation(read_relation(spark, path, name), path, name, run, buckets)
    _switch(slots.select(F.lit(run).alias("run"), "relation", *SLOT, "buckets").distinct(), path)
