"""Corpus scans: file trees listed and read by tasks, ignore rules, decoding."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.functions.paths import index_language, parent_dirs
from corpuslens.session import cut
from corpuslens.skew import salted_join


_LISTING = "root_path string, location string, file_path string, is_dir boolean, size_bytes long, mtime_ns long"


def _list_level(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One level of entries below each folder of the batch; symbolic links are left out."""
    columns = ["root_path", "location", "file_path", "is_dir", "size_bytes", "mtime_ns"]
    for batch in batches:
        for root, location, folder in zip(batch.root_path, batch.location, batch.folder):
            lead = f"{folder}/" if folder else ""
            out = []
            if "://" in location:
                fs, base = pyarrow.fs.FileSystem.from_uri(location)
                where = f"{base}/{folder}".rstrip("/")
                for e in fs.get_file_info(pyarrow.fs.FileSelector(where)):
                    is_dir = e.type == pyarrow.fs.FileType.Directory
                    out.append((root, location, lead + e.base_name, is_dir, e.size or 0, e.mtime_ns or 0))
            else:
                with os.scandir(os.path.join(location, folder)) as entries:
                    for e in entries:
                        if e.is_dir(follow_symlinks=False):
                            out.append((root, location, lead + e.name, True, 0, 0))
                        elif e.is_file(follow_symlinks=False):
                            stat = e.stat(follow_symlinks=False)
                            out.append((root, location, lead + e.name, False, stat.st_size, stat.st_mtime_ns))
            yield pd.DataFrame(out, columns=columns)


IGNORE_FILES = (".gitignore", ".ignore")


def list_trees(roots: DataFrame, keep_hidden: bool = False, ignore_files: bool = False) -> DataFrame:
    """Every file below ``roots(root_path, location)``: stat columns, no content.

    Spark's own file sources skip empty files and names that start with an underscore,
    and source trees are full of both. So folders are listed by tasks, one tree level
    per round for all roots together; a wide folder level spreads over the cluster.
    Hidden entries and what is below them are left out, but for the ignore files if
    those are wanted (see :func:`list_visible`).
    """
    name = F.substring_index("file_path", "/", -1)
    wanted = name.isin(*IGNORE_FILES) if ignore_files else F.lit(False)
    found = []
    level, n = roots.select("root_path", "location", F.lit("").alias("folder")), 1
    while n:
        spread = level.repartition("root_path", "folder")
        entries = spread.mapInPandas(_list_level, _LISTING)
        if not keep_hidden:
            entries = entries.where(~F.startswith(name, F.lit(".")) | wanted)
        entries, n = cut(entries, "listing", F.count_if("is_dir"))
        found.append(entries.where(~F.col("is_dir")).drop("is_dir"))
        level = entries.where("is_dir").select("root_path", "location", F.col("file_path").alias("folder"))
    return reduce(DataFrame.unionByName, found)


def _read_batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        # One file per output batch keeps the worker's memory to the largest file.
        for i in range(len(batch)):
            one = batch.iloc[i : i + 1].copy()
            location, path = one.location.iloc[0], one.file_path.iloc[0]
            if "://" in location:
                fs, base = pyarrow.fs.FileSystem.from_uri(location)
                with fs.open_input_stream(f"{base}/{path}") as f:
                    one["content"] = [f.read()]
            else:
                with open(os.path.join(location, path), "rb") as f:
                    one["content"] = [f.read()]
            yield one


def read_content(listing: DataFrame) -> DataFrame:
    """Adds ``content`` (binary) to a listing; filter the listing first.

    Rows are spread by path hash, since listings keep big folders together.
    """
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in listing.schema) + ", content binary"
    return listing.repartition("root_path", "file_path").mapInPandas(_read_batch, schema)


def list_visible(roots: DataFrame) -> DataFrame:
    """Files of the roots that their own ignore files do not hide."""
    every = list_trees(roots, ignore_files=True)
    ignoring = F.substring_index("file_path", "/", -1).isin(*IGNORE_FILES)
    texts, _ = decoded(read_content(every.where(ignoring)))
    return apply_ignore(every.where(~ignoring), ignore_rules(texts))


def scan_files(spark: SparkSession, path: str, root: str | None = None, keep_hidden: bool = False) -> DataFrame:
    """All files below one folder, with content."""
    roots = spark.createDataFrame([(path if root is None else root, path)], "root_path string, location string")
    return read_content(list_trees(roots, keep_hidden))


def indexable(files: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Files of a known language, with ``language``; all sizes, or those below ``max_bytes``."""
    known = files.withColumn("language", index_language(F.col("file_path"))).where(F.col("language").isNotNull())
    return known if max_bytes is None else known.where(F.col("size_bytes") < max_bytes)


def decoded(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files with text content and hash, files skipped because they are not UTF-8)."""
    text = F.col("content").cast("string")
    good = files.where(F.is_valid_utf8(text)).withColumn(
        "content_hash", F.sha2("content", 256)
    ).withColumn("content", text)
    return good, files.where(~F.is_valid_utf8(text)).drop("content")


def ignore_rules(ignore_files: DataFrame) -> DataFrame:
    """Rules from ignore files: (root_path, dir, pattern, negated, dir_only, anchored, ord).

    ``ignore_files(root_path, file_path, content)`` are ``.gitignore`` files; deeper
    files and later lines come later in ``ord`` and win.
    """
    folder = F.regexp_replace(F.regexp_replace("file_path", r"[^/]*$", ""), r"/$", "")
    lines = ignore_files.select(
        "root_path", folder.alias("dir"), F.posexplode(F.split("content", r"\r?\n")).alias("_n", "_t")
    )
    text = F.regexp_replace("_t", r"(?<!\\)\s+$", "")
    lines = lines.select("root_path", "dir", "_n", text.alias("_t")).where((F.col("_t") != "") & ~F.startswith("_t", F.lit("#")))
    negated = F.startswith(F.col("_t"), F.lit("!"))
    body = F.regexp_replace("_t", r"^!|^\\(?=[!#])", "")
    pattern = F.regexp_replace(body, r"/+$", "")
    return lines.select(
        "root_path", "dir", F.regexp_replace(pattern, "^/", "").alias("pattern"), negated.alias("negated"),
        F.endswith(body, F.lit("/")).alias("dir_only"), F.contains(pattern, F.lit("/")).alias("anchored"),
        F.struct(F.when(F.col("dir") == "", 0).otherwise(F.size(F.split("dir", "/"))).alias("depth"), F.col("_n").alias("n")).alias("ord"),
    )


def glob_pattern(pattern: Column) -> Column:
    """Glob text to a regular expression as a column (``**``, ``*``, ``?``, ``[]``)."""
    quoted = F.regexp_replace(pattern, r"([.+^$(){}|])", r"\\$1")
    star = F.regexp_replace(quoted, r"\*\*/", "\u0001")
    star = F.regexp_replace(star, r"\*\*", "\u0002")
    star = F.regexp_replace(star, r"\*", "[^/]*")
    star = F.regexp_replace(star, r"\?", "[^/]")
    star = F.regexp_replace(star, r"\[!", "[^")
    star = F.regexp_replace(star, "\u0001", "(?:.*/)?")
    return F.regexp_replace(star, "\u0002", ".*")


def apply_ignore(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Files that no rule of their root ignores; the last matching rule decides.

    A rule applies below its own folder. Each distinct path part (a file or one of
    the folders above it) meets each rule folder it is in once, as an equi-join on
    (root, folder) with that folder's rules in one array, at most one ignore file long.
    An ignored folder hides everything below it, and what is below cannot be taken back.
    """
    keys = ["root_path", "part"]
    regex = F.concat(F.lit("^"), F.when(F.col("anchored"), "").otherwise("(?:.*/)?"), glob_pattern(F.col("pattern")), F.lit("$"))
    by_dir = rules.groupBy("root_path", "dir").agg(
        F.array_sort(F.collect_list(F.struct("ord", regex.alias("re"), "negated", "dir_only"))).alias("rules")
    )
    above = parent_dirs(F.col("file_path"))
    whole = F.struct(F.col("file_path").alias("part"), F.lit(False).alias("is_dir"))
    folders = F.transform(above, lambda d: F.struct(d.alias("part"), F.lit(True).alias("is_dir")))
    parts = files.select("root_path", F.inline(F.concat(folders, F.array(whole)))).distinct()
    asked = parts.select(
        "*", F.explode(F.concat(F.array(F.lit("")), parent_dirs(F.col("part")))).alias("dir")
    )
    below = F.when(F.col("dir") == "", F.col("part")).otherwise(F.substr("part", F.length("dir") + 2))
    hits = F.filter("rules", lambda r: (F.col("is_dir") | ~r["dir_only"]) & F.rlike(below, r["re"]))
    last = F.try_element_at(hits, F.lit(-1))
    ignored = (
        salted_join(asked, by_dir, ["root_path", "dir"], "inner", ["part"])
        .select(*keys, last.alias("_r")).where(F.col("_r").isNotNull())
        .groupBy(*keys).agg(F.max_by(F.col("_r.negated"), F.col("_r.ord")).alias("_back"))
        .where(~F.col("_back")).select(*keys)
    )
    hidden = (
        files.select("root_path", "file_path", F.explode(F.concat(above, F.array("file_path"))).alias("part"))
        .join(ignored, keys, "left_semi").select("root_path", "file_path").distinct()
    )
    return files.join(hidden, ["root_path", "file_path"], "left_anti")
