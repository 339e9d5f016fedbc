"""Conversation logs and package manifests as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslens import schemas
from corpuslens.functions.outcome import outcome
from corpuslens.functions.paths import storage_name

# Manifest version and defaults of entries written by older versions.
MANIFEST_VERSION = 1
DEFAULT_SCOPE = "global"


def log_path(identifier: Column, started_at: Column, log_id: Column) -> Column:
    """``<encoded package>/<yyyyMMdd-HHmmss>-<first 8 of id>.json``"""
    stamp = F.date_format(started_at, "yyyyMMdd-HHmmss")
    return F.concat(storage_name(identifier), F.lit("/"), stamp, F.lit("-"), F.substring(log_id, 1, 8), F.lit(".json"))


def write_logs(logs: DataFrame, path: str) -> None:
    """Append logs as JSON lines in one folder per package; each row carries its ``log_path``.

    A cluster job writes part files rather than one file per log: millions of tiny
    objects would be slower to list than to read.
    """
    (
        logs.withColumn("package_dir", storage_name(F.col("package_identifier")))
        .withColumn("log_path", log_path(F.col("package_identifier"), F.to_timestamp("started_at"), F.col("id")))
        .write.mode("append").partitionBy("package_dir").json(path)
    )


def read_logs(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Log documents with ``shown``: the response, or the raw text of a file that has none.

    ``multiline`` reads one JSON document per file, else one per line. Text that is
    no JSON is kept whole in ``raw``.
    """
    fields = T.StructType(schemas.LOG.fields)
    if not multiline:
        # Plain text columns keep the raw line for the fallback.
        lines = spark.read.option("recursiveFileLookup", True).text(path)
        return parse_logs(lines.withColumnRenamed("value", "raw"), fields)
    whole = spark.read.option("recursiveFileLookup", True).option("wholetext", True).text(path)
    return parse_logs(whole.withColumnRenamed("value", "raw"), fields)


def parse_logs(raw: DataFrame, fields: T.StructType = schemas.LOG) -> DataFrame:
    """Log columns, ``outcome`` and ``shown`` from rows with a ``raw`` text."""
    parsed = raw.withColumn("_j", F.from_json("raw", fields, {"mode": "PERMISSIVE"}))
    return parsed.select(
        "_j.*", "raw",
        F.coalesce("_j.response", "raw").alias("shown"),
        F.when(F.col("_j.id").isNotNull(), outcome(F.col("_j.exit_code"))).alias("outcome"),
    )


def manifest_entries(packages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries of git packages with an address, identifiers of the packages left out)."""
    git = (F.col("source_type") == "git") & F.col("source_url").isNotNull()
    entries = packages.where(git).select(
        "identifier", F.col("source_url").alias("git"), F.col("source_branch").alias("branch"),
        "harness", "auto_pull", "shallow", "prepare_scope",
    )
    return entries, packages.where(~git).select("identifier")


def entry_json(entries: DataFrame) -> DataFrame:
    """One manifest text per entry, null fields left out: ``{"version":1,"packages":[..]}``.

    A registry of any size is a folder of such lines; a single document would have to be
    put together in one task. :func:`parse_manifest` reads both.
    """
    doc = F.struct(F.lit(MANIFEST_VERSION).alias("version"), F.array(F.struct(*schemas.MANIFEST_ENTRY.names)).alias("packages"))
    return entries.select(F.to_json(doc).alias("manifest"))


def write_manifest(entries: DataFrame, path: str) -> None:
    entry_json(entries).write.mode("overwrite").text(path)


def parse_manifest(texts: DataFrame, column: str = "manifest") -> DataFrame:
    """Entries of manifest texts; a text of another version fails the job."""
    schema = T.StructType([
        T.StructField("version", T.IntegerType()),
        T.StructField("packages", T.ArrayType(schemas.MANIFEST_ENTRY)),
    ])
    parsed = texts.select(F.from_json(column, schema, {"mode": "FAILFAST"}).alias("_m"))
    version = F.col("_m.version")
    bad = F.raise_error(
        F.concat(F.lit("unsupported manifest version "), F.coalesce(version.cast("string"), F.lit("none")))
    ).cast("int")
    checked = F.when(version.eqNullSafe(F.lit(MANIFEST_VERSION)), version).otherwise(bad)
    # The filter uses the checked value, so the check cannot be pruned away.
    return parsed.where(checked == MANIFEST_VERSION).select(F.inline("_m.packages")).withColumns({
        "shallow": F.coalesce("shallow", F.lit(False)),
        "prepare_scope": F.coalesce("prepare_scope", F.lit(DEFAULT_SCOPE)),
    })


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a manifest file (one document) or folder (documents by line)."""
    text = spark.read.text(path, wholetext=True).withColumnRenamed("value", "manifest")
    docs = text.select(F.explode(F.split(F.trim("manifest"), r"(?<=\})\s*\n\s*(?=\{\"version\")")).alias("manifest"))
    return parse_manifest(docs)
