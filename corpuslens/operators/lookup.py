"""Lookups over the index relations: symbols, words, outlines, line ranges, listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuslens.functions.paths import in_scope, parent_dirs, tree_language
from corpuslens.functions.text import (
    fold_ascii,
    is_identifier,
    line_count,
    line_tokens,
    split_lines,
)
from corpuslens.operators.extract import fallback_outline
from corpuslens.session import cut
from corpuslens.skew import DEFAULT_BUDGET, salt_of, salted_join, top_n

HOT_LIMIT = 20
FILE = ["root_path", "file_path"]

# Order of listings; every one is total, so a limit on it is repeatable.
LISTING_ORDER = {
    "symbols": [*FILE, "line", "name", "kind"],
    "imports": [*FILE, "line", "target"],
    "identifiers": [*FILE, "line", "token"],
    "deps": ["root_path", "importer_file", "line", "raw_target"],
    "callsites": ["root_path", "caller_file", "caller_line", "callee_name", "callee_kind", "caller_symbol"],
    "packages": ["identifier"],
    "tree": ["root_path", "path"],
}


def listing(rows: DataFrame, relation: str) -> DataFrame:
    """Rows of a relation in the order they are listed."""
    return rows.orderBy(*LISTING_ORDER[relation])


def find(rows: DataFrame, column: str, value: str) -> DataFrame:
    """Rows by id or identifier."""
    return rows.where(F.col(column) == value)


def forward_edges(deps: DataFrame, root: str, importer: str) -> DataFrame:
    """Imports of one file with what they resolve to, by line."""
    return deps.where((F.col("root_path") == root) & (F.col("importer_file") == importer)).orderBy("line", "raw_target")


def callsites_of(callsites: DataFrame, root: str, name: str) -> DataFrame:
    """Callsites of one name, by file and line."""
    return listing(callsites.where((F.col("root_path") == root) & (F.col("callee_name") == name)), "callsites")


def lines(files: DataFrame) -> DataFrame:
    """Every line of every file, 1-based.

    Exploded as outer rows and filtered after: an inner explode has Spark test for empty arrays first, by making them once more.
    """
    return files.select(*FILE, F.posexplode_outer(split_lines(F.col("content"))).alias("_pos", "text")).where(
        "_pos is not null"
    ).select(*FILE, (F.col("_pos") + 1).alias("line"), "text")


def identifiers(line_rows: DataFrame, text: str = "text") -> DataFrame:
    """Inverted index rows (file, line, token), once per token and line."""
    return line_rows.select(*FILE, F.explode_outer(line_tokens(F.col(text))).alias("token"), "line").where("token is not null")


def word_hits(index: DataFrame, token: str, ignore_case: bool = False) -> DataFrame:
    """Lines that hold ``token``; with ``ignore_case`` only A-Z fold."""
    have = fold_ascii(F.col("token")) if ignore_case else F.col("token")
    want = fold_ascii(F.lit(token)) if ignore_case else F.lit(token)
    return index.where(have == want).select(*FILE, "line", "token")


def corpus_word_hits(files: DataFrame, token: str, ignore_case: bool = False) -> DataFrame:
    """The same straight from file rows: texts and lines without the word are dropped before tokens are made."""
    want = fold_ascii(F.lit(token)) if ignore_case else F.lit(token)
    fold = fold_ascii if ignore_case else (lambda c: c)
    near = lines(files.where(F.contains(fold(F.col("content")), want))).where(F.contains(fold(F.col("text")), want))
    return word_hits(identifiers(near), token, ignore_case)


def word_hits_many(index: DataFrame, words: DataFrame, ignore_case: bool = False) -> DataFrame:
    """The same for a table of requests ``words(word)``."""
    have = fold_ascii(F.col("token")) if ignore_case else F.col("token")
    want = fold_ascii(F.col("word")) if ignore_case else F.col("word")
    return salted_join(
        index.withColumn("_key", have),
        words.select("word", want.alias("_key")).distinct(),
        ["_key"], "inner", [*FILE, "line"],
    ).select("word", *FILE, "line", "token")


def word_totals(index: DataFrame) -> DataFrame:
    """Hits and distinct files of every token of an identifier relation."""
    per_file = index.groupBy("token", *FILE).agg(F.count(F.lit(1)).alias("n"))
    return per_file.groupBy("token").agg(
        F.sum("n").alias("hits"), F.count(F.lit(1)).alias("files")
    )


def corpus_word_totals(files: DataFrame) -> DataFrame:
    """The same straight from file rows, with one shuffle.

    A file row is whole in its task, so each file contributes its own line hits
    and a single file count per token, and only per-task token sums are shuffled.
    """
    per_line = F.transform(
        split_lines(F.col("content")),
        lambda x: F.array_distinct(F.regexp_extract_all(x, F.lit(r"[\p{L}_][\p{L}\p{N}_]*"), F.lit(0))),
    )
    found = files.select(F.flatten(per_line).alias("_all"))
    hits = F.transform("_all", lambda t: F.struct(t.alias("token"), F.lit(1).alias("h"), F.lit(0).alias("f")))
    once = F.transform(
        F.array_distinct("_all"),
        lambda t: F.struct(t.alias("token"), F.lit(0).alias("h"), F.lit(1).alias("f")),
    )
    return (
        found.select(F.inline_outer(F.concat(hits, once)))
        .where(is_identifier(F.col("token")))
        .groupBy("token")
        .agg(F.sum("h").alias("hits"), F.sum("f").alias("files"))
    )


def symbols_named(symbols: DataFrame, name: str, kind: str | None = None, prefix: bool = False) -> DataFrame:
    """Definitions by exact name (case counts) or by prefix (A-Z fold)."""
    if prefix:
        found = symbols.where(F.startswith(fold_ascii(F.col("name")), fold_ascii(F.lit(name))))
    else:
        found = symbols.where(F.col("name") == name)
    return found if kind is None else found.where(F.col("kind") == kind)


def symbols_named_many(symbols: DataFrame, names: DataFrame) -> DataFrame:
    """Definitions for a table of requests ``names(name)``."""
    return salted_join(symbols, names.select("name").distinct(), ["name"], "inner", [*FILE, "line"])


def outline(files: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """One row per file with its symbols and imports as arrays ordered by line."""
    syms = symbols.groupBy(*FILE).agg(
        F.array_sort(
            F.collect_list(
                F.struct("line", "name", "kind", "end_line", "parent", "visibility", "signature")
            )
        ).alias("symbols")
    )
    imps = imports.groupBy(*FILE).agg(F.array_sort(F.collect_list(F.struct("line", "target"))).alias("imports"))
    return files.join(syms, FILE, "left").join(imps, FILE, "left")


def outline_or_fallback(files: DataFrame, indexed: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """Outline rows of the asked ``files``: from the index, or the generic outline of their text.

    ``indexed`` is the files relation. Indexed files are left out before any line is made, so
    only the others are outlined. Their names are written first: by their true size Spark can send them to where texts are.
    """
    asked = files.select(*FILE)
    known = outline_rows(symbols.join(asked, FILE, "left_semi"), imports.join(asked, FILE, "left_semi"))
    names, _ = cut(indexed.select(*FILE).join(asked, FILE, "left_semi"), "indexed")
    rest = files.join(names, FILE, "left_anti")
    generic = fallback_outline(lines(rest))
    return known.unionByName(outline_rows(generic, imports.where(F.lit(False))))


def outline_rows(symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """The outline as rows tagged ``symbol`` or ``import``."""
    return symbols.select(
        *FILE, "line", F.lit("symbol").alias("entry"), "kind", F.col("name").alias("text")
    ).unionByName(
        imports.select(
            *FILE, "line", F.lit("import").alias("entry"),
            F.lit(None).cast("string").alias("kind"), F.col("target").alias("text"),
        )
    )


def symbols_by_kind(symbols: DataFrame) -> DataFrame:
    """Symbol count per file and kind, with the names in line order."""
    return symbols.groupBy(*FILE, "kind").agg(
        F.count(F.lit(1)).alias("n"),
        F.array_sort(F.collect_list(F.struct("line", "name"))).alias("members"),
    )


def read_ranges(files: DataFrame, ranges: DataFrame) -> DataFrame:
    """Lines ``start..end`` for requests ``ranges(root_path, file_path, start, end)``.

    start is at least 1; an end before the start reads one line; a start beyond the
    last line reads nothing. Nulls mean the first and the last line. Only files that
    are asked for are kept, and each brings its hash and line total.
    """
    total = F.size("_lines")
    # One short row per file, written: by its true size Spark can send it to where the texts are.
    asked, _ = cut(ranges.groupBy(*FILE).agg(F.collect_list(F.struct("start", "end")).alias("_asks")), "ranges")
    whole = files.select(*FILE, "content").join(asked, FILE).select(
        *FILE, "_asks", F.sha2(F.col("content").cast("binary"), 256).alias("content_hash"), split_lines(F.col("content")).alias("_lines"))

    def answer(ask: Column) -> Column:
        first = F.greatest(F.coalesce(ask["start"], F.lit(1)), F.lit(1))
        last = F.greatest(F.least(F.coalesce(ask["end"], total), total), first)
        texts = F.slice("_lines", first, last - first + 1)
        line = F.transform(texts, lambda x, i: F.struct((first + i).alias("line"), x.alias("text")))
        return F.struct(ask["start"].alias("start"), ask["end"].alias("end"), line.alias("got"))

    return whole.select(*FILE, "content_hash", total.alias("total_lines"), F.explode_outer(F.transform("_asks", answer)).alias("_a")).select(
        *FILE, "_a.start", "_a.end", "content_hash", "total_lines", F.inline("_a.got"))


def lines_in_budget(files: DataFrame, budget: int = DEFAULT_BUDGET) -> DataFrame:
    """Lines of each root, by file and line, while their bytes fit ``budget``: (file, line, used_bytes, truncated).

    A line counts its bytes and one. Bytes are added up per file first, and running sums over files tell where a root is
    cut; only the files up to there are cut into lines, and of each no more lines than the budget has bytes. What is
    shuffled are sizes and numbers, never text.
    """
    sizes = F.transform(split_lines(F.col("content")), lambda x: F.octet_length(x).cast("long") + 1)
    per_file = files.select(*FILE, sizes.alias("_sizes")).select(
        *FILE, F.aggregate("_sizes", F.lit(0).cast("long"), lambda a, x: a + x).alias("_bytes"), F.slice("_sizes", 1, budget).alias("_sizes"))
    totals, _ = cut(per_file.select(*FILE, "_bytes").where("_bytes > 0"), "bytes")
    share = W.partitionBy("root_path", "_salt").orderBy("file_path").rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy("root_path").orderBy("file_path").rowsBetween(W.unboundedPreceding, 0)
    over = totals.groupBy("root_path").agg((F.sum("_bytes") > budget).alias("truncated"))
    # A file that its own share's files rule out is ruled out; so the last sum sees few files of a root.
    cuts = totals.withColumn("_salt", salt_of(["file_path"])).withColumn("_part", F.sum("_bytes").over(share)).where(
        F.col("_part") - F.col("_bytes") < budget
    ).withColumn("_before", F.sum("_bytes").over(whole) - F.col("_bytes")).where(F.col("_before") < budget)
    cuts, _ = cut(cuts.join(over, "root_path").select(*FILE, "_before", "truncated"), "cuts")
    rows = per_file.join(cuts, FILE).select(*FILE, "_before", "truncated", F.posexplode("_sizes").alias("_pos", "_size"))
    within = W.partitionBy(*FILE).orderBy("_pos").rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("used_bytes", F.col("_before") + F.sum("_size").over(within)).where(F.col("used_bytes") <= budget).select(
        *FILE, (F.col("_pos") + 1).alias("line"), "used_bytes", "truncated")


def symbol_counts(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Symbols per indexed file; an indexed file without any counts 0."""
    counted = symbols.groupBy(*FILE).agg(F.count(F.lit(1)).alias("_n"))
    return (
        files.select(*FILE).join(counted, FILE, "left")
        .select(*FILE, F.coalesce("_n", F.lit(0)).cast("long").alias("symbols"))
    )


def tree(files: DataFrame, counts: DataFrame | None = None, max_depth: int | None = None) -> DataFrame:
    """Listing of files and their directories with depth and per-file notes.

    ``counts`` comes from :func:`symbol_counts`; files it lacks keep null, as do
    directories. ``files`` needs ``content`` and ``size_bytes``.
    """
    entries = files.select(
        *FILE,
        tree_language(F.col("file_path")).alias("language"),
        line_count(F.col("content")).alias("lines"),
        F.col("size_bytes").cast("long").alias("size_bytes"),
    )
    if counts is None:
        entries = entries.withColumn("symbols", F.lit(None).cast("long"))
    else:
        entries = entries.join(counts.select(*FILE, "symbols"), FILE, "left")
    dirs = files.select("root_path", F.explode(parent_dirs(F.col("file_path"))).alias("file_path")).distinct()
    both = entries.withColumn("is_dir", F.lit(False)).unionByName(
        dirs.withColumn("is_dir", F.lit(True)), allowMissingColumns=True
    )
    both = both.withColumnRenamed("file_path", "path").withColumn(
        "depth", F.size(F.split("path", "/"))
    )
    return both if max_depth is None else both.where(F.col("depth") <= max_depth)


def directory_totals(files: DataFrame) -> DataFrame:
    """Files, bytes and lines under every directory, the root included as ''.

    Partial sums per task keep the hot root directory a single small group.
    """
    every = F.concat(F.array(F.lit("")), parent_dirs(F.col("file_path")))
    counted = files.select("root_path", "file_path", F.col("size_bytes").cast("long").alias("_b"), line_count(F.col("content")).alias("_l"))
    return (
        # Lines are counted once per file, before each of its directories gets a row.
        counted.select("root_path", F.explode(every).alias("path"), "_b", "_l")
        .groupBy("root_path", "path")
        .agg(
            F.count(F.lit(1)).alias("files"),
            F.sum("_b").alias("size_bytes"),
            F.coalesce(F.sum("_l"), F.lit(0)).alias("lines"),
        )
    )


def hot_files(files: DataFrame, limit: int = HOT_LIMIT) -> DataFrame:
    """Most recently modified files of all roots together."""
    return files.orderBy(F.desc("mtime_ns"), "root_path", "file_path").limit(limit)


def hot_files_per_root(files: DataFrame, limit: int = HOT_LIMIT) -> DataFrame:
    """Most recently modified files of each root, with ``rank``."""
    return top_n(files, ["root_path"], [F.desc("mtime_ns"), F.asc("file_path")], limit, ["file_path"])


def scoped(rows: DataFrame, path: str, scope: str | None) -> DataFrame:
    """Keep rows at or below ``scope`` by whole path parts."""
    return rows if scope is None else rows.where(in_scope(F.col(path), F.lit(scope)))
