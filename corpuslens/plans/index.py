"""The index build: diff, extract what is stale, resolve, write. Full and incremental alike."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.operators import extract as X
from corpuslens.operators.resolve import go_modules, resolve_imports
from corpuslens.operators.snapshot import diff_snapshots, evicted, moved, stale
from corpuslens.session import cut
from corpuslens.skew import salted_join
from corpuslens.sources.corpus import decoded, indexable, read_content
from corpuslens.sources.index_store import SCHEMAS, bucket_count, read_relation, replace_files

FILE = ["root_path", "file_path"]
EXTRACTED = ("symbols", "imports", "identifiers", "callsites")


def extract_relations(files: DataFrame) -> dict[str, DataFrame]:
    """symbols, imports, identifiers and callsites of text files.

    One pass over the lines gives all but the imports, and is written once.
    """
    scanned, _ = cut(X.scan(files), "scanned")
    return {
        "symbols": X.symbols_of(scanned),
        "imports": X.imports(files),
        "identifiers": X.identifiers_of(scanned),
        "callsites": X.callsites_of(scanned),
    }


def table_reader(files: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Reader for a corpus that is already a table with ``content``."""
    return lambda wanted: files.select(*FILE, "content").join(wanted, FILE)


def build_index(
    spark: SparkSession,
    listing: DataFrame,
    path: str,
    reader: Callable[[DataFrame], DataFrame] = read_content,
    packages: DataFrame | None = None,
    now: Column | None = None,
    only: DataFrame | None = None,
    removals: bool = True,
) -> DataFrame:
    """Bring the index at ``path`` up to date with the ``listing``; returns counts per root.

    ``listing`` is the whole tree without content (``sources.list_trees``); ``reader`` adds
    ``content`` to the rows it is given, which are only the files whose time or size moved.
    ``only(root_path, file_path)`` limits the run to some files; ``removals=False`` keeps
    index rows of files that ``listing`` lacks. Imports that earlier runs could not resolve
    are tried again, so a file that appears later repairs them. All relations change at once or, if the
    run fails, not at all.
    """
    now = F.current_timestamp() if now is None else now
    known = indexable(listing)
    if only is not None:
        known = known.join(only.select(*FILE).distinct(), FILE, "left_semi")
        removals = False
    index = read_relation(spark, path, "files")
    # Text is read once and kept, without the files that are not UTF-8.
    unseen = moved(known, index)
    text, _ = cut(decoded(reader(unseen))[0], "text")
    skipped, _ = cut(unseen.join(text.select(*FILE), FILE, "left_anti").select(*FILE), "skipped")
    hashes = text.select(*FILE, "content_hash")
    diff = diff_snapshots(known.join(skipped, FILE, "left_anti"), index, hashes)
    if not removals:
        diff = diff.where("status <> 'removed'")
    moves = F.col("status").isin("missing", "changed", "removed")
    diff, changes = cut(diff, "diff", F.count_if(moves))
    # The names of stale files are written, short rows of true size that go to the texts; the texts are not copied.
    names, _ = cut(stale(diff), "stale")
    good = text.join(names, FILE, "left_semi")
    none = lambda name: spark.createDataFrame([], SCHEMAS[name])
    fresh = extract_relations(good) if changes else {n: none(n) for n in EXTRACTED}
    fresh["imports"] = cut(fresh["imports"], "imports")[0]  # the others are parts of one written table
    records = good.select(
        *FILE, "language", "mtime_ns", "size_bytes", "content_hash", F.lit("").alias("package_id"), now.alias("indexed_at")
    )
    if packages is not None:
        ids = packages.groupBy(F.col("path").alias("root_path")).agg(F.min("identifier").alias("_id"))
        records = salted_join(records, ids, ["root_path"], "left", ["file_path"]).withColumn(
            "package_id", F.coalesce("_id", F.lit(""))
        ).drop("_id")
    fresh["files"] = cut(records, "files")[0] if changes else none("files")
    stats, _ = cut(index_stats(fresh, skipped, diff), "stats")

    gone, _ = cut(evicted(diff).unionByName(stale(diff)).distinct(), "gone")
    edges, retried = _edges(spark, listing, path, index, fresh, diff, good, reader)
    new = {"deps": (edges, retried)}
    if changes:
        new |= {n: (fresh[n], gone) for n in (*EXTRACTED, "files")}
    replace_files(spark, path, new, bucket_count(spark, path, listing))
    return stats


def _edges(spark, listing, path, index, fresh, diff, good, reader) -> tuple[DataFrame, DataFrame]:
    """New dependency rows, and the files whose rows they replace.

    Besides the stale files these are the importers whose target was not found
    before or has gone: what they import may have appeared or changed place.
    """
    gone = evicted(diff)
    importer = ["root_path", "importer_file"]
    as_importer = lambda df: df.select("root_path", F.col("file_path").alias("importer_file"))
    kept = read_relation(spark, path, "deps").join(as_importer(gone), importer, "left_anti")
    removed = diff.where("status = 'removed'").select("root_path", F.col("file_path").alias("importee_file"))
    broken = kept.where("importee_file is null").unionByName(
        kept.join(removed, ["root_path", "importee_file"], "left_semi").select(*kept.columns)
    )
    broken, _ = cut(broken, "broken")
    again = broken.select("root_path", F.col("importer_file").alias("file_path"), F.col("raw_target").alias("target"), "line")
    touched = again.select(*FILE).distinct()
    asks, n = cut(fresh["imports"].unionByName(again), "asks")
    if not n:
        # Nothing to resolve; only the rows of changed and removed files go.
        return read_relation(spark, path, "deps").where(F.lit(False)), gone.unionByName(stale(diff)).distinct()
    languages = good.select(*FILE, "language").unionByName(
        index.join(gone, FILE, "left_anti").select(*FILE, "language")
    )
    # Of all files only the names matter here, and the text of each go.mod.
    modules = reader(listing.where(F.col("file_path") == "go.mod")).select(
        *FILE, F.col("content").cast("string").alias("content")
    )
    deps = resolve_imports(asks.join(languages, FILE), listing, go_modules(modules))
    # A retried file gets all its edges written again, so take its other ones along.
    steady = kept.join(as_importer(touched), importer, "left_semi").join(
        broken, [*importer, "raw_target", "line"], "left_anti"
    )
    edges, _ = cut(deps.unionByName(steady.select(*deps.columns)), "deps")
    return edges, gone.unionByName(stale(diff)).unionByName(touched).distinct()


def index_stats(fresh: dict[str, DataFrame], skipped: DataFrame, diff: DataFrame) -> DataFrame:
    """Per root: files indexed, skipped, current and removed, and rows extracted."""
    parts = [
        fresh["files"].select("root_path", F.lit("files_indexed").alias("k")),
        skipped.select("root_path", F.lit("files_skipped").alias("k")),
        diff.select(
            "root_path",
            F.when(F.col("status").isin("current", "touched"), "files_current")
            .when(F.col("status") == "removed", "files_removed").alias("k"),
        ).where("k is not null"),
        *(fresh[n].select("root_path", F.lit(n).alias("k")) for n in ("symbols", "imports", "identifiers")),
    ]
    names = ["files_indexed", "files_skipped", "files_current", "files_removed", "symbols", "imports", "identifiers"]
    return reduce(DataFrame.unionByName, parts).groupBy("root_path").agg(
        *(F.count_if(F.col("k") == n).alias(n) for n in names)
    )
