"""Every operator as a query over the test tables, bound as in ``bindings``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslens.functions import outcome as O
from corpuslens.functions import paths as P
from corpuslens.functions import text as T
from corpuslens.operators import commits as C
from corpuslens.operators import extract as X
from corpuslens.operators import graph as G
from corpuslens.operators import lookup as L
from corpuslens.operators import postings as PO
from corpuslens.operators import registry as R
from corpuslens.operators import resolve as RS
from corpuslens.operators import search as S
from corpuslens.operators import snapshot as SN
from corpuslens.plans import bindings as B
from corpuslens.plans.index import build_index, table_reader
from corpuslens.session import scratch_path, tune
from corpuslens.skew import ranked
from corpuslens.sources import records as RC
from corpuslens.sources.index_store import read_relation
from corpuslens.streaming import streams as ST

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Beginnings of prose lines that stand in for definitions.
PROSE_RULES = (
    ("The ", "the"), ("And ", "and"), ("Of ", "of"), ("De ", "de"), ("Der ", "der"), ("Und ", "und"), ("La ", "la"),
)
NOW = F.lit  # times are literals, so results do not depend on the clock


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(tune(spark), sf_dir)

    QUERIES[fn.__name__] = run
    return fn


def big(*names: str) -> list[Column]:
    return [F.col(n).cast("long").alias(n) for n in names]


def stamp(name: str) -> Column:
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(name)


def at(text: str) -> Column:
    return F.lit(text).cast("timestamp")


# -- words, files, outlines ---------------------------------------------------


@query
def word_hits(spark, d):
    """Lines of all documents that hold the identifier ``The``."""
    return L.corpus_word_hits(B.files(spark, d), "The").select("root_path", "file_path", *big("line"), "token")


@query
def word_hits_ignore_case(spark, d):
    return L.corpus_word_hits(B.files(spark, d), "LA", ignore_case=True).select("root_path", "file_path", *big("line"), "token")


@query
def word_hits_many(spark, d):
    """Occurrences of every language code and of the benchmark's words, as one batch."""
    words = B.table(spark, d, "benchmark").select(F.explode(T.line_tokens(F.col("text"))).alias("word")).distinct()
    hits = L.word_hits_many(L.identifiers(L.lines(B.files(spark, d))), words)
    return hits.groupBy("word").agg(F.count(F.lit(1)).alias("hits"))


@query
def word_counts(spark, d):
    """Hits and files of every identifier."""
    return L.corpus_word_totals(B.files(spark, d)).select("token", *big("hits", "files"))


@query
def identifier_index(spark, d):
    """Size of the inverted index per file."""
    rows = L.identifiers(L.lines(B.files(spark, d)))
    return rows.groupBy("root_path", "file_path").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("line").cast("long")).alias("line_sum"),
        F.sum(F.octet_length("token")).alias("token_bytes"),
    )


@query
def file_stats(spark, d):
    """Language by both maps, lines, bytes, hash and symbol count of every file."""
    files = B.files(spark, d)
    symbols = X.fallback_outline(L.lines(files), PROSE_RULES)
    counts = L.symbol_counts(files.where("language is not null"), symbols)
    notes = files.select(
        "root_path", "file_path", "language", P.tree_language(F.col("file_path")).alias("label"),
        T.line_count(F.col("content")).alias("lines"), "size_bytes",
        F.sha2(F.col("content").cast("binary"), 256).alias("content_hash"),
    )
    return notes.join(counts, ["root_path", "file_path"], "left")


@query
def outline_fallback(spark, d):
    out = X.fallback_outline(L.lines(B.files(spark, d)), PROSE_RULES)
    return out.select("root_path", "file_path", "name", "kind", *big("line"), "signature")


@query
def symbols_ranked(spark, d):
    """Every outline entry with its place in the listing of all."""
    out = ranked(X.fallback_outline(L.lines(B.files(spark, d)), PROSE_RULES), L.LISTING_ORDER["symbols"])
    return out.select("root_path", "file_path", "name", "kind", *big("line", "rank"))


@query
def symbol_exact(spark, d):
    out = L.symbols_named(X.fallback_outline(L.lines(B.files(spark, d)), PROSE_RULES), "the")
    return out.select("root_path", "file_path", "name", "kind", *big("line"))


@query
def symbol_prefix(spark, d):
    out = L.symbols_named(X.fallback_outline(L.lines(B.files(spark, d)), PROSE_RULES), "TH", prefix=True, kind="of")
    return out.select("root_path", "file_path", "name", "kind", *big("line"))


@query
def symbols_by_kind(spark, d):
    """Symbols of each file grouped by kind, names in line order."""
    out = L.symbols_by_kind(X.fallback_outline(L.lines(B.files(spark, d)), PROSE_RULES))
    return out.select(
        "root_path", "file_path", "kind", *big("n"),
        F.array_join(F.transform("members", lambda m: m["name"]), ",").alias("names"),
    )


@query
def file_outline(spark, d):
    """Symbols and imports of every generated source file as one row per file."""
    files = B.code_files(spark, d)
    symbols = X.symbols_of(X.scan(files, ("symbols",)))
    out = L.outline(files.select("root_path", "file_path", "language"), symbols, X.imports(files))
    return out.select(
        "root_path", "file_path", "language",
        F.array_join(F.transform("symbols", lambda s: F.concat_ws(":", s["line"].cast("string"), s["kind"], s["name"])), ",").alias("symbols"),
        F.array_join(F.transform("imports", lambda s: F.concat_ws(":", s["line"].cast("string"), s["target"])), ",").alias("imports"),
    )


@query
def outline_mixed(spark, d):
    """Outline of every document: from the index where its language is known, else the generic one."""
    files = B.files(spark, d)
    indexed = files.where("language is not null")
    symbols = X.fallback_outline(L.lines(indexed), PROSE_RULES)
    imports = L.word_hits(L.identifiers(L.lines(indexed)), "license", ignore_case=True).select(
        "root_path", "file_path", F.col("token").alias("target"), "line"
    )
    out = L.outline_or_fallback(files, indexed, symbols, imports)
    return out.select("root_path", "file_path", *big("line"), "entry", "kind", "text")


@query
def read_ranges(spark, d):
    """A line range of every document: in order, reversed, open, and beyond the end."""
    files = B.files(spark, d)
    start = (F.col("mtime_ns") / 1000 % 9).cast("int") - 1
    ranges = files.select(
        "root_path", "file_path", start.alias("start"),
        (start + (F.col("size_bytes") % 5).cast("int") - 1).alias("end"),
    )
    return L.read_ranges(files, ranges).select(
        "root_path", "file_path", *big("start", "end", "total_lines", "line"), "content_hash", "text"
    )


# -- search -------------------------------------------------------------------


@query
def search_lines(spark, d):
    out = S.search(B.files(spark, d), "license", context=0, ignore_case=True)
    return out.select("root_path", "file_path", *big("line", "column"), "text")


@query
def search_context(spark, d):
    hits = S.context_rows(S.search(B.files(spark, d), "[Ll]icen[cs]e", context=2))
    return hits.select("root_path", "file_path", *big("match_line", "line", "offset"), "text")


@query
def search_narrowed(spark, d):
    """Search within one language, some folders and not others."""
    out = S.search(B.files(spark, d), "The +[a-z]+", 0, language="c", globs=("{en,de}/**", "!*5.h"))
    return out.select("root_path", "file_path", *big("line", "column"), "text")


@query
def search_indexed(spark, d):
    """The search for license lines again, over the files that stored letter triples leave."""
    files, path = B.files(spark, d), scratch_path(spark, "grams")
    PO.write_postings(PO.gram_postings(files), path)
    out = PO.search_indexed(files, path, "license", 0, ignore_case=True)
    return out.select("root_path", "file_path", *big("line", "column"), "text")


@query
def word_lookup(spark, d):
    """Hits of one word through stored postings of all words."""
    path = scratch_path(spark, "words")
    PO.write_postings(PO.word_postings(L.identifiers(L.lines(B.files(spark, d)))), path)
    return PO.word_hits(spark, path, "LA", ignore_case=True).select("root_path", "file_path", *big("line"), "token")


# -- trees and recency ----------------------------------------------------------


@query
def tree_listing(spark, d):
    files = B.page_files(spark, d)
    return L.tree(files.drop("page_id"), max_depth=3).select(
        "root_path", "path", "language", *big("lines", "size_bytes", "depth"), "is_dir"
    )


@query
def tree_counts(spark, d):
    """The whole tree of all documents, with the number of outline entries of each file."""
    files = B.files(spark, d)
    counts = L.symbol_counts(files, X.fallback_outline(L.lines(files), PROSE_RULES))
    return L.tree(files, counts).select("root_path", "path", "language", *big("lines", "size_bytes", "depth", "symbols"), "is_dir")


@query
def relative_paths(spark, d):
    """Paths below each document's root, and as they are where the next lower root is asked for."""
    files = B.files(spark, d).select("root_path", F.concat_ws("/", "root_path", "file_path").alias("full"))
    below = P.relative_to(F.concat("root_path", F.lit("/")), F.col("full"))
    return files.select("full", below.alias("below"), P.relative_to(F.concat("root_path", F.lit("0")), F.col("full")).alias("other"))


def _least_part(spark, d):
    """(brand, part) with the least number of all parts that some order goes on from."""
    row = B.part_deps(spark, d).agg(F.min(F.struct(F.col("importer_file").cast("long").alias("n"), "root_path"))["root_path"].alias("r"), F.min(F.col("importer_file").cast("long")).alias("n")).first()
    return row["r"], str(row["n"])


@query
def edges_of_part(spark, d):
    """Imports of one part in their order."""
    root, part = _least_part(spark, d)
    rows = L.forward_edges(B.part_deps(spark, d), root, part)
    place = F.row_number().over(Window.partitionBy("root_path", "importer_file").orderBy("line", "raw_target", "importee_file"))
    return rows.select("root_path", "importer_file", "raw_target", "importee_file", *big("line"), place.cast("long").alias("place"))


@query
def calls_of_part(spark, d):
    """Callsites of one part."""
    root, part = _least_part(spark, d)
    return L.callsites_of(B.part_calls(spark, d), root, part).select("root_path", "caller_file", *big("caller_line"), "callee_kind", "caller_symbol")


@query
def tree_rollup(spark, d):
    return L.directory_totals(B.files(spark, d)).select("root_path", "path", *big("files", "size_bytes", "lines"))


def _event_files(spark, d):
    e = B.table(spark, d, "events")
    return e.groupBy(F.col("event_type").alias("root_path"), F.concat(F.lit("u/"), F.col("user_id").cast("string")).alias("file_path")).agg(
        (F.max(F.unix_micros(F.col("ts").cast("timestamp"))) * 1000).alias("mtime_ns")
    )


@query
def hot_files(spark, d):
    return L.hot_files(_event_files(spark, d), 20)


@query
def hot_files_per_root(spark, d):
    return L.hot_files_per_root(_event_files(spark, d), 5).select("root_path", "file_path", "mtime_ns", *big("rank"))


# -- code -----------------------------------------------------------------------


@query
def code_symbols(spark, d):
    """Symbols with extent and parent of the generated source files."""
    out = X.symbols_of(X.scan(B.code_files(spark, d), ("symbols",)))
    return out.select("root_path", "file_path", "name", "kind", *big("line", "end_line"), "parent", "visibility", "signature")


@query
def code_imports(spark, d):
    return X.imports(B.code_files(spark, d)).select("root_path", "file_path", "target", *big("line"))


@query
def code_callsites(spark, d):
    out = X.callsites_of(X.scan(B.code_files(spark, d), ("callsites",)))
    return out.select("root_path", "caller_file", *big("caller_line"), "caller_symbol", "callee_name", "callee_kind")


@query
def code_identifiers(spark, d):
    """Identifiers outside comments and strings."""
    out = X.code_identifiers(X.code_lines(B.code_files(spark, d)))
    return out.groupBy("root_path", "token").agg(F.count(F.lit(1)).alias("hits")).select("root_path", "token", *big("hits"))


@query
def nested_symbols(spark, d):
    """Symbols of generated JavaScript and C files with blocks in blocks, as many as an order has lines."""
    out = X.symbols_of(X.scan(B.nested_files(spark, d), ("symbols",)))
    return out.select("root_path", "file_path", "name", "kind", *big("line", "end_line"), "parent", "signature")


@query
def nested_callsites(spark, d):
    out = X.callsites_of(X.scan(B.nested_files(spark, d), ("callsites",)))
    return out.select("root_path", "caller_file", *big("caller_line"), "caller_symbol", "callee_name", "callee_kind")


# -- resolution -----------------------------------------------------------------


@query
def import_resolution(spark, d):
    """Each document imports the next one of its language family and folder, in the manner of its language.

    Every third asks for a number that no document has.
    """
    files = B.files(spark, d)
    lang = F.substring_index("file_path", "/", 1)
    js = F.col("language").isin("typescript", "tsx", "javascript")
    family = F.when(js, "js").when(F.col("language").isin("c", "cpp"), "c").otherwise(F.col("language"))
    numbered = files.drop("content").withColumn("number", F.regexp_extract("file_path", r"/(\d+)", 1).cast("long")).withColumn("ending", F.regexp_extract("file_path", r"/\d+\.(.*)$", 1))
    row = Window.partitionBy("root_path", lang, family).orderBy("number")
    asking = numbered.where("language is not null").withColumn("next", F.lead("number").over(row)).withColumn("next_ending", F.lead("ending").over(row))
    other = F.when((F.col("number") % 3 == 0) | F.col("next").isNull(), F.col("number") + 10_000_000_000).otherwise(F.col("next")).cast("string")
    target = (
        F.when(F.col("language") == "rust", F.concat(F.lit("crate::"), lang, F.lit("::"), other, F.lit("::{Item, Other}")))
        .when(js, F.concat(F.lit("import x from './"), other, F.lit("'")))
        .when(F.col("language") == "python", F.concat(F.lit("from ."), other, F.lit(" import x")))
        .otherwise(F.concat(F.lit("../"), lang, F.lit("/"), other, F.lit("."), F.coalesce("next_ending", F.lit("h"))))
    )
    imports = asking.select("root_path", "file_path", "language", target.alias("target"), F.lit(1).alias("line"))
    return RS.resolve_imports(imports, files).select("root_path", "importer_file", "importee_file", "raw_target")


@query
def link_resolution(spark, d):
    """Links of pages, without query and fragment: ``/x`` means the least page of the host at or below ``x``."""
    pages = B.page_files(spark, d)
    hrefs = F.transform(F.regexp_extract_all("content", F.lit("""href=["']([^"']*)["']"""), F.lit(1)), lambda h: F.regexp_replace(h, "[?#].*$", ""))
    asks = pages.select("root_path", "page_id", F.explode(F.array_distinct(hrefs)).alias("href"))
    clean = P.normalize(F.regexp_replace("href", "^/+|/+$", ""))
    tries = F.when(F.startswith(F.col("href"), F.lit("/")), F.array(clean, F.concat(clean, F.lit("/"))))
    tops = pages.select("root_path", F.explode(P.parent_dirs(F.col("file_path"))).alias("dir"), "file_path")
    lookup = pages.select("root_path", F.col("file_path").alias("key"), F.col("file_path").alias("path")).unionByName(
        tops.select("root_path", F.concat("dir", F.lit("/")).alias("key"), F.col("file_path").alias("path"))
    ).groupBy("root_path", "key").agg(F.min("path").alias("path"))
    return RS.first_existing(asks.withColumn("_c", tries), ["root_path", "page_id", "href"], "_c", lookup)


# -- graphs ---------------------------------------------------------------------


@query
def deps_forward(spark, d):
    """Dependencies of every part within three hops."""
    edges = G.resolved_edges(B.part_deps(spark, d))
    return G.deps(edges, B.part_starts(spark, d), "forward", 3).select("root_path", "start", "node", *big("hop"))


@query
def deps_reverse(spark, d):
    edges = G.resolved_edges(B.part_deps(spark, d))
    return G.deps(edges, B.part_starts(spark, d), "reverse", 2).select("root_path", "start", "node", *big("hop"))


@query
def deps_both(spark, d):
    """Nodes per hop in both directions, as far as the walks go."""
    edges = G.resolved_edges(B.part_deps(spark, d))
    return G.whole_walk_sizes(edges, B.part_starts(spark, d)).select("root_path", "start", "direction", *big("hop", "n"))


@query
def deps_unresolved(spark, d):
    return G.unresolved(B.part_deps(spark, d), B.part_starts(spark, d))


@query
def reverse_importers(spark, d):
    """Distinct importers of every file."""
    edges = G.resolved_edges(B.part_deps(spark, d))
    return G.reversed_edges(edges).distinct().select("root_path", F.col("src").alias("file"), F.col("dst").alias("importer"))


@query
def impact_sites(spark, d):
    """Callsites of every part within three hops."""
    out = G.impact(B.part_calls(spark, d), B.part_starts(spark, d), 3)
    return out.select("root_path", "start", *big("hop", "caller_line"), "caller_file", "caller_symbol", "callee_name", "callee_kind")


@query
def impact_scoped(spark, d):
    """Direct impact per part with a file scope: definitions, kept, dropped, note."""
    calls, starts = B.part_calls(spark, d), B.part_starts(spark, d)
    symbols = B.part_deps(spark, d).where("importee_file is not null").select(
        "root_path", F.col("importee_file").alias("name"), "line"
    ).distinct()
    notes = G.impact_notes(symbols, starts, G.impact(calls, starts), "o/3")
    return notes.select("root_path", "start", *big("definitions", "kept", "dropped"), "note")


@query
def impact_definitions(spark, d):
    """What defines each part's name: the parts that import it, by line."""
    symbols = B.part_deps(spark, d).where("importee_file is not null").select(
        "root_path", F.col("importee_file").alias("name"), F.col("importer_file").alias("file_path"), "line"
    ).distinct()
    return G.impact_definitions(symbols, B.part_starts(spark, d)).select("root_path", "start", "file_path", *big("line"))


@query
def cycles_ranked(spark, d):
    """Members of cycles with their place in the listing of all."""
    found = G.cycles(G.resolved_edges(B.part_deps(spark, d)))
    return ranked(found, G.CYCLE_ORDER).select("root_path", "component", "member", *big("size", "rank"))


@query
def cycles(spark, d):
    return G.cycles(G.resolved_edges(B.part_deps(spark, d))).select("root_path", "component", *big("size"), "member")


@query
def ahead_count(spark, d):
    """Commits ahead of each parent, for every parent and child of the commit graph."""
    commits = B.part_commits(spark, d)
    pairs = commits.where("parent is not null").select("root_path", F.col("parent").alias("base"), F.col("sha").alias("head"))
    return C.ahead_count(commits, pairs)


@query
def map_freshness(spark, d):
    """Freshness of a map made at each part's least successor, itself, or nowhere."""
    commits = B.part_commits(spark, d)
    least = commits.groupBy("root_path", "sha").agg(F.min("parent").alias("recorded"))
    asks = least.select("root_path", "recorded", F.col("sha").alias("current")).unionByName(
        least.select("root_path", F.col("sha").alias("recorded"), F.col("sha").alias("current"))
    )
    out = C.commits_behind(commits, asks)
    return out.select("root_path", "recorded", "current", "behind", O.freshness(F.col("behind")).alias("freshness"))


# -- snapshots ------------------------------------------------------------------

REMOVED = (12, 5)  # documents with this remainder are gone from the disk


def _index_and_disk(spark, d):
    """Index: documents that are labelled, short, or gone from the disk. Disk: all but one remainder of their numbers, license lines gone."""
    hashed = lambda df: df.withColumn("content_hash", F.sha2(F.col("content").cast("binary"), 256))
    docs = B.files(spark, d).withColumn("doc_id", F.regexp_extract("file_path", r"/(\d+)", 1).cast("long"))
    labelled = B.table(spark, d, "labels").select("doc_id").distinct().withColumn("seen", F.lit(True))
    removed = F.col("doc_id") % REMOVED[0] == REMOVED[1]
    index = docs.join(labelled, "doc_id", "left").where(F.col("seen") | (F.col("size_bytes") < 500) | removed).drop("seen", "doc_id")
    text = F.regexp_replace("content", r"(?m)^.*License.*$", "")
    disk = docs.withColumn("content", text).withColumn("size_bytes", F.octet_length("content").cast("long")).where(
        ~removed
    ).drop("doc_id").withColumn("mtime_ns", F.col("mtime_ns") + F.when(F.col("size_bytes") % 2 == 0, 1).otherwise(0))
    return hashed(index), hashed(disk)


@query
def snapshot_diff(spark, d):
    index, disk = _index_and_disk(spark, d)
    hashes = SN.moved(disk, index).select("root_path", "file_path", "content_hash")
    return SN.diff_snapshots(disk.drop("content_hash"), index, hashes)


@query
def index_upsert(spark, d):
    """The outline relation after the update: kept rows of steady files, new rows of stale ones."""
    index, disk = _index_and_disk(spark, d)
    diff = SN.diff_snapshots(disk, index)
    old = X.fallback_outline(L.lines(index), PROSE_RULES)
    fresh = disk.join(SN.stale(diff), ["root_path", "file_path"], "left_semi")
    new = X.fallback_outline(L.lines(fresh), PROSE_RULES)
    return SN.upsert(old, new, SN.evicted(diff)).select("root_path", "file_path", "name", "kind", *big("line"))


@query
def index_build(spark, d):
    """The index of all documents after two runs: a full one, then one of the labelled documents only, license lines gone."""
    path = scratch_path(spark, "index")
    files = B.files(spark, d)
    text = F.regexp_replace("content", r"(?m)^.*License.*$", "")
    disk = files.withColumn("content", text).withColumn("size_bytes", F.octet_length("content").cast("long")).withColumn("mtime_ns", F.col("mtime_ns") + 1)
    labelled = B.table(spark, d, "labels").select("doc_id").distinct()
    only = files.withColumn("doc_id", F.regexp_extract("file_path", r"/(\d+)", 1).cast("long")).join(labelled, "doc_id", "left_semi")
    for state, wanted in ((files, None), (disk, only)):
        build_index(spark, state.drop("content"), path, table_reader(state), now=at("2024-01-01"), only=wanted)
    return read_relation(spark, path, "files").select("root_path", "file_path", "language", "mtime_ns", "size_bytes", "content_hash", stamp("indexed_at"))


# -- registry ---------------------------------------------------------------------


@query
def nearest_package(spark, d):
    """The package each customer's working folder belongs to."""
    pk = B.packages(spark, d)
    nations = B.table(spark, d, "nation").select(
        F.concat(F.lit(B.CLONES + "/"), F.lower(F.replace("n_name", F.lit(" "), F.lit("_")))).alias("path"), F.col("n_name").alias("identifier")
    )
    homes = pk.where("source_type = 'git'").select("path", "identifier").unionByName(nations)
    work = pk.select("id", F.concat("path", F.lit("/src/"), "id").alias("path"))
    return R.assign_package(work, homes).select("id", "path", "package")


@query
def history_recent(spark, d):
    """Five newest conversations of every package within 1000 days of a date."""
    pk = B.packages(spark, d)
    out = R.history(B.conversations(spark, d), pk, pk.select("identifier"), at("2000-01-01"), 1000, 5)
    return out.select("identifier", "id", "exit_code", stamp("created_at"), *big("rank"), T.display(F.col("question")).alias("shown")).withColumn(
        "exit_code", F.col("exit_code").cast("long")
    )


@query
def recent_questions(spark, d):
    """Three newest user turns of every conversation, cut for display."""
    turns = B.table(spark, d, "conversations").where("role = 'user'").select(
        F.col("conv_id").cast("string").alias("package_id"), F.col("turn").cast("string").alias("id"), F.col("text").alias("question"),
        F.timestamp_seconds("turn").alias("created_at"),
    )
    return R.recent_questions(turns, 3).select("package_id", "id", *big("rank"), T.display(F.col("question")).alias("shown"))


@query
def last_activity(spark, d):
    return R.last_activity(B.conversations(spark, d)).select("package_id", stamp("last_activity"))


@query
def latest_map(spark, d):
    """Latest map of every user, without and per branch."""
    p = B.prepared(spark, d)
    both = R.latest_global(p).unionByName(R.latest_per_branch(p))
    return both.select("package_id", "git_branch", "id", "content", stamp("created_at"))


@query
def latest_map_by_scope(spark, d):
    """The map every package uses: by branch for branch scope, else the global one."""
    wants = B.packages(spark, d).select(
        F.col("id").alias("package_id"), "prepare_scope", F.when(F.col("auto_pull"), F.lit("click")).alias("branch")
    )
    out = R.latest_by_scope(B.prepared(spark, d), wants)
    return out.select("package_id", "prepare_scope", "branch", F.col("map.id").alias("map_id"))


@query
def map_upsert(spark, d):
    """Maps of the first quarter replaced by those after it."""
    p = B.prepared(spark, d)
    cutoff = at("2024-01-10")
    out = R.replace_prepared(p.where(F.col("created_at") < cutoff), p.where(F.col("created_at") >= cutoff))
    return out.select("package_id", "git_branch", "id", stamp("created_at"))


@query
def retention(spark, d):
    """Clones whose every package is stale, with their packages."""
    out = R.stale_clones(
        B.packages(spark, d), B.conversations(spark, d), B.prepared(spark, d), B.CLONES, at("2001-06-01")
    )
    return out.select("path", stamp("activity"), "identifier")


@query
def package_activity(spark, d):
    out = R.package_activity(B.packages(spark, d), B.conversations(spark, d), B.prepared(spark, d))
    return out.select("id", stamp("activity"))


@query
def registry_cascade(spark, d):
    """Rows left per package after the shallow ones are deleted."""
    pk = B.packages(spark, d)
    left = R.delete_packages(pk, B.conversations(spark, d), B.prepared(spark, d), pk.where("shallow").select("id"))
    counts = [df.groupBy(F.col(k).alias("id")).agg(F.count(F.lit(1)).alias("n")).withColumn("relation", F.lit(r))
              for df, k, r in zip(left, ("id", "package_id", "package_id"), ("packages", "conversations", "maps"))]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query
def registry_orphans(spark, d):
    """Maps of users that are no registered package, against those that are."""
    kept, refused = R.accept_conversations(B.prepared(spark, d), B.packages(spark, d).where("source_type = 'git'"))
    return kept.select("id", F.lit("kept").alias("state")).unionByName(refused.select("id", F.lit("refused").alias("state")))


@query
def registry_insert(spark, d):
    """Packages of all customers once more, added where their identifier is free; display names clash on purpose."""
    pk = B.packages(spark, d)
    new = pk.withColumn("identifier", F.col("path")).withColumn("id", F.concat(F.lit("n"), "id"))
    merged, rejected = R.insert_packages(pk, new)
    return merged.select("id", "identifier", F.lit("present").alias("state")).unionByName(
        rejected.select("id", "identifier", F.lit("rejected").alias("state"))
    )


@query
def registry_settings(spark, d):
    """Property changes of every package, valid or not, and the packages after them."""
    pk = B.packages(spark, d)
    value = F.when(F.col("source_branch").isNotNull(), "true").when(F.col("shallow"), "maybe").otherwise("false")
    settings = (
        pk.select("identifier", F.lit("auto-pull").alias("key"), value.alias("value"), F.lit(False).alias("unset"))
        .unionByName(pk.select("identifier", F.lit("harness").alias("key"), F.coalesce("harness", F.lit("beta")).alias("value"), F.col("shallow").alias("unset")))
        .unionByName(pk.select("identifier", F.lit("prepare-scope").alias("key"), F.when(F.col("auto_pull"), "branch").alias("value"), F.lit(False).alias("unset")))
    )
    names = spark.range(1).select(F.explode(F.array(F.lit("alpha"), F.lit("beta"))).alias("name"))
    merged, refused = R.set_properties(pk, settings, names, at("2024-01-01"))
    return merged.select(
        "identifier", F.lit("state").alias("key"),
        F.concat_ws("|", F.col("auto_pull").cast("string"), F.coalesce("harness", F.lit("-")), "prepare_scope").alias("value"),
    ).unionByName(refused.select("identifier", "key", F.col("reason").alias("value")))


@query
def clone_reuse(spark, d):
    return R.first_package_per_url(B.packages(spark, d)).select("source_url", "id", "path")


@query
def packages_per_path(spark, d):
    return R.packages_per_path(B.packages(spark, d)).select("path", *big("n"))


@query
def removable_paths(spark, d):
    """Clones free to go when packages without auto-pull or with a long path are removed."""
    pk = B.packages(spark, d)
    return R.removable_paths(pk, pk.where("not auto_pull or length(path) > 26").select("id"), B.CLONES)


@query
def run_outcome(spark, d):
    """Outcome class of every order's run; a success with a blank answer counts as failed."""
    o = B.table(spark, d, "orders")
    code = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 7)
    answer = F.when(F.col("o_orderpriority").startswith("1"), " \n\t").otherwise(F.col("o_orderpriority"))
    before = F.when(F.col("o_totalprice") > 100000, "main")
    after = F.when(F.col("o_custkey") > 100, F.when(F.col("o_totalprice") > 200000, "main").otherwise("dev"))
    return o.select(
        "o_orderkey", O.outcome(O.recorded_exit(code, answer)).cast("long").alias("outcome"),
        O.recorded_response(code, answer).alias("response"),
        O.provenance(before, after).alias("branch"), O.provenance_changed(before, after).alias("moved"),
    )


@query
def identifier_valid(spark, d):
    """Customer names and page URLs as identifiers: why they are refused."""
    names = B.table(spark, d, "customer").select(F.col("c_name").alias("identifier"))
    paths = B.page_files(spark, d).select(F.concat_ws("/", "root_path", "file_path").alias("identifier"))
    urls = B.table(spark, d, "pages").select(F.col("url").alias("identifier"))
    odd = paths.select(F.explode(F.array(F.concat(F.lit("/"), "identifier"), F.concat("identifier", F.lit("/")), F.concat(F.lit("a//../"), "identifier"), F.concat(F.lit("a/../b//"), "identifier"), F.lit(""))).alias("identifier"))
    every = names.unionByName(paths).unionByName(urls).unionByName(odd).distinct()
    return every.select("identifier", P.identifier_problem(F.col("identifier")).alias("problem"))


@query
def url_valid(spark, d):
    u = F.col("url")
    forms = F.array(u, F.regexp_replace("url", "^https?://", "git@"), F.concat(F.lit("ftp"), u), F.regexp_replace("url", "^https?:/", ""),
                    F.regexp_replace("url", "^https?://([^/]*)/", "me@$1:"))
    return B.table(spark, d, "pages").select(F.explode(forms).alias("url")).distinct().select(
        "url", P.url_valid(F.col("url")).alias("valid"), P.url_insecure(F.col("url")).alias("insecure")
    )


@query
def storage_names(spark, d):
    return B.table(spark, d, "pages").select("url", P.storage_name(F.col("url")).alias("name"))


@query
def sanitize_cap(spark, d):
    """Every document as a map: fenced, cleaned and capped."""
    docs = B.table(spark, d, "documents")
    fenced = F.when(F.pmod("doc_id", F.lit(2)) == 0, F.concat(F.lit("  ```text\n"), F.col("text"), F.lit("\n \n\n``` \n"))).otherwise(F.col("text"))
    # Each step is its own column, so that no step is worked out twice.
    out = docs.select("doc_id", fenced.alias("raw"))
    out = out.withColumn("clean", T.sanitize_map(F.col("raw"))).withColumn("capped", T.cap_bytes(F.col("clean")))
    return out.select(
        "doc_id", F.sha2("clean", 256).alias("clean_hash"), F.sha2("capped", 256).alias("capped_hash"),
        F.octet_length("capped").cast("long").alias("capped_bytes"),
    )


@query
def manifest_roundtrip(spark, d):
    """Git packages written as manifest text and read back."""
    entries, _ = RC.manifest_entries(B.packages(spark, d))
    return RC.parse_manifest(RC.entry_json(entries))


@query
def manifest_import(spark, d):
    """Status of every exported entry against the packages with auto-pull and two known harnesses."""
    pk = B.packages(spark, d)
    entries, _ = RC.manifest_entries(pk)
    names = spark.range(1).select(F.explode(F.array(F.lit("alpha"), F.lit("beta"))).alias("name"))
    return R.import_status(entries, pk.where("auto_pull"), names).select("identifier", "status")


@query
def manifest_tally(spark, d):
    pk = B.packages(spark, d)
    entries, skipped = RC.manifest_entries(pk)
    names = spark.range(1).select(F.lit("alpha").alias("name"))
    out = R.import_tally(R.import_status(entries, pk.where("auto_pull"), names))
    return out.unionByName(skipped.groupBy(F.lit("local").alias("status")).agg(F.count(F.lit(1)).alias("n")))


@query
def log_roundtrip(spark, d):
    """Conversation turns as log documents, some of them no JSON, parsed again."""
    c = B.table(spark, d, "conversations")
    doc = F.to_json(F.struct(
        F.col("conv_id").cast("string").alias("id"), F.when(F.col("role") == "assistant", 0).when(F.col("role") == "user", 3).alias("exit_code"),
        F.when(F.col("turn") % 3 != 1, F.col("text")).alias("response"),
    ))
    raw = c.select("conv_id", "turn", F.when(F.col("role") == "system", F.col("text")).otherwise(doc).alias("raw"), "role")
    out = RC.parse_logs(raw.withColumn("raw", F.col("raw")))
    return out.groupBy("outcome").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("response")).alias("response_bytes"), F.count("id").alias("parsed"),
        F.sum(F.when(F.col("response").isNotNull() | F.col("id").isNull(), F.octet_length("shown"))).alias("shown_bytes"),
    ).select(*big("outcome", "n", "response_bytes", "parsed", "shown_bytes"))


@query
def prompt_batch(spark, d):
    """The prompt for every user's question: package, map by scope, three recent questions."""
    pk = B.packages(spark, d)
    asks = pk.select(
        F.col("id").alias("ask_id"), "identifier", F.concat(F.lit("Where is "), "display_name", F.lit("?")).alias("question"),
        F.when(F.col("auto_pull"), F.lit("click")).alias("branch"), F.when(F.col("source_branch").isNotNull(), F.lit("head")).alias("current_commit"),
        F.pmod(F.length("path") * 7, F.lit(14)).cast("long").alias("behind"),
    )
    return R.assemble_prompts(asks, pk, B.conversations(spark, d), B.prepared(spark, d), context=3)


@query
def byte_budget(spark, d):
    """Lines of each source, in order, while they fit 16 KiB."""
    out = L.lines_in_budget(B.files(spark, d), 16384)
    return out.select("root_path", "file_path", *big("line", "used_bytes"), "truncated")


# -- streams ----------------------------------------------------------------------


@query
def stream_last_activity(spark, d):
    """Running last activity over the orders, drained once."""
    orders = ST.parquet_stream(spark, d, "orders").select(
        F.col("o_custkey").cast("string").alias("package_id"), F.col("o_orderdate").cast("timestamp").alias("created_at")
    )
    return ST.drain(ST.last_activity(orders), "update", ["package_id"]).select("package_id", stamp("last_activity"))


@query
def stream_outcomes(spark, d):
    """Log records classified as they arrive, drained once."""
    raw = ST.parquet_stream(spark, d, "orders").select(
        F.to_json(F.struct(
            F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("response"),
            F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).alias("exit_code"),
        )).alias("raw")
    )
    return ST.drain(ST.outcomes(raw), "append").select("id", *big("outcome"), "shown")


@query
def stream_index(spark, d):
    """The outline relation kept current from a stream of documents, drained once."""
    docs = ST.parquet_stream(spark, d, "documents").select(
        F.col("source").alias("root_path"), F.concat("lang", F.lit("/"), F.col("doc_id").cast("string")).alias("file_path"), F.col("text").alias("content"),
        F.col("doc_id").alias("mtime_ns"),
    )
    out = ST.index_stream(docs, lambda files: X.fallback_outline(L.lines(files), PROSE_RULES))
    return out.select("root_path", "file_path", "name", "kind", *big("line"))
