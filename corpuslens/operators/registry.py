"""Registry of packages with history: upserts, cascades, latest-per-key, retention, prompts.

Changes return new DataFrames; writing them is the caller's step. A package may own a
large share of the conversations or maps, so per-package answers are aggregates
that combine in the map task, or top-n in two stages; request lists join salted.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.functions.outcome import FRESH, SLIGHTLY_STALE, UNKNOWN, freshness
from corpuslens.functions.paths import ancestors, in_scope
from corpuslens.session import cut
from corpuslens.skew import salted_join, top_n

# Columns an update may change, and the settable properties.
MUTABLE = (
    "display_name", "source_url", "source_branch", "path", "auto_pull", "harness", "shallow", "prepare_scope",
)
DEFAULT_HISTORY = 20


def _first(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """The whole row with the least ``order`` per key (map-side combined, no window)."""
    row = F.struct(*df.columns)
    return df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(
        F.min_by(row, order).alias("_r")
    ).select("_r.*")


def _latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The rows with the greatest ``order`` of each key, null keys among them.

    Only keys and order are aggregated, so wide columns are not sorted or shuffled for it; they are written, so that by their
    true size Spark can send them to where the rows are. An order that ends with the id leaves one row of a key.
    """
    best = df.groupBy(*keys).agg(F.max(F.struct(*order)).alias("_o")).select(
        *(F.col(k).alias(f"_k_{k}") for k in keys), *(F.col(f"_o.{o}").alias(f"_o_{o}") for o in order))
    best, _ = cut(best, "latest")
    same = [F.col(c).eqNullSafe(F.col(f"_{side}_{c}")) for side, names in (("k", keys), ("o", order)) for c in names]
    return df.join(best, reduce(lambda a, b: a & b, same), "left_semi")


# -- packages ---------------------------------------------------------------


def insert_packages(packages: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Add packages whose identifier is free: (all packages, rejected rows).

    Of new rows with one identifier the first by (created_at, id) is taken.
    """
    free = new.join(packages.select("identifier"), "identifier", "left_anti").select(*new.columns)
    taken = _first(free, ["identifier"], F.struct("created_at", "id"))
    rejected = new.join(taken.select("id"), "id", "left_anti").select(*new.columns)
    return packages.unionByName(taken), rejected


def update_packages(packages: DataFrame, updates: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Apply ``updates(id, ..)``: (all packages, updates without a package).

    Columns that are absent or null keep their value; names in an optional
    ``clear`` array column are set to null.
    """
    given = [c for c in MUTABLE if c in updates.columns]
    cleared = F.coalesce(F.col("u.clear"), F.array().cast("array<string>")) if "clear" in updates.columns else F.array().cast("array<string>")
    joined = packages.alias("p").join(updates.alias("u"), F.col("p.id") == F.col("u.id"), "left")
    hit = F.col("u.id").isNotNull()

    def value(name: str) -> Column:
        if name == "updated_at":
            return F.when(hit, now).otherwise(F.col("p.updated_at"))
        if name not in MUTABLE:
            return F.col(f"p.{name}")
        new = F.coalesce(F.col(f"u.{name}"), F.col(f"p.{name}")) if name in given else F.col(f"p.{name}")
        return F.when(F.array_contains(cleared, name), None).otherwise(new)

    merged = joined.select(*(value(c).alias(c) for c in packages.columns))
    return merged, updates.join(packages.select("id"), "id", "left_anti")


def setting_problem(key: Column, value: Column, unset: Column, harness_known: Column) -> Column:
    """Why a property setting is refused, null when it is fine."""
    return (
        F.when(~key.isin("auto-pull", "harness", "prepare-scope"), "unknown property")
        .when(unset & (key != "harness"), "cannot unset")
        .when(~unset & value.isNull(), "missing value")
        .when((key == "auto-pull") & ~value.isin("true", "false"), "invalid value")
        .when((key == "prepare-scope") & ~value.isin("global", "branch"), "invalid value")
        .when((key == "harness") & ~unset & ~harness_known, "harness not configured")
    )


def set_properties(
    packages: DataFrame, settings: DataFrame, harnesses: DataFrame, now: Column
) -> tuple[DataFrame, DataFrame]:
    """Apply ``settings(identifier, key, value, unset)``: (all packages, refused rows with reason).

    ``harnesses(name)`` lists the configured ones. A package takes one setting per key.
    """
    known = harnesses.select(F.col("name").alias("value"), F.lit(True).alias("_known")).distinct()
    ids = packages.select("identifier", F.col("id").alias("_id"))
    checked = settings.join(known, "value", "left").join(ids, "identifier", "left").withColumn(
        "reason",
        F.when(F.col("_id").isNull(), "package not found").otherwise(
            setting_problem(F.col("key"), F.col("value"), F.col("unset"), F.coalesce("_known", F.lit(False)))
        ),
    )
    good = checked.where(F.col("reason").isNull())
    pick = lambda key: F.max(F.when(F.col("key") == key, F.col("value")))
    updates = good.groupBy(F.col("_id").alias("id")).agg(
        pick("auto-pull").cast("boolean").alias("auto_pull"),
        pick("harness").alias("harness"),
        pick("prepare-scope").alias("prepare_scope"),
        F.when(F.bool_or((F.col("key") == "harness") & F.col("unset")), F.array(F.lit("harness"))).alias("clear"),
    )
    merged, _ = update_packages(packages, updates, now)
    return merged, checked.where(F.col("reason").isNotNull()).select("identifier", "key", "value", "unset", "reason")


def delete_packages(
    packages: DataFrame, conversations: DataFrame, prepared: DataFrame, ids: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Remove packages by ``ids(id)`` with their conversations and maps."""
    gone = ids.select("id").distinct()
    owner = gone.withColumnRenamed("id", "package_id")
    return (
        packages.join(gone, "id", "left_anti"),
        salted_join(conversations, owner, ["package_id"], "left_anti", ["id"]).select(*conversations.columns),
        salted_join(prepared, owner, ["package_id"], "left_anti", ["id"]).select(*prepared.columns),
    )


def accept_conversations(conversations: DataFrame, packages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of known packages, rows of unknown ones)."""
    owner = packages.select(F.col("id").alias("package_id")).distinct().withColumn("_known", F.lit(True))
    told = salted_join(conversations, owner, ["package_id"], "left", ["id"])
    pick = lambda known: told.where(F.col("_known").isNotNull() == known).select(*conversations.columns)
    return pick(True), pick(False)


def first_package_per_url(packages: DataFrame) -> DataFrame:
    """The package registered first for each address; its clone is the one to reuse."""
    return _first(packages.where(F.col("source_url").isNotNull()), ["source_url"], F.struct("created_at", "id"))


def packages_per_path(packages: DataFrame) -> DataFrame:
    return packages.groupBy("path").agg(F.count(F.lit(1)).alias("n"))


def removable_paths(packages: DataFrame, removed: DataFrame, clone_dir: str) -> DataFrame:
    """Managed paths of ``removed(id)`` packages that no surviving package uses."""
    gone = packages.join(removed.select("id").distinct(), "id", "left_semi")
    left = packages.join(removed.select("id").distinct(), "id", "left_anti")
    managed = gone.where(in_scope(F.col("path"), F.lit(clone_dir))).select("path").distinct()
    return managed.join(left.select("path").distinct(), "path", "left_anti")


def assign_package(paths: DataFrame, packages: DataFrame, explicit: str | None = None) -> DataFrame:
    """Adds ``package`` (identifier) to ``paths(path, ..)``: the nearest registered ancestor.

    Packages on one path: the first by identifier. ``explicit`` names a column whose
    value, where not null, overrides the search. Directories are looked up once each,
    not once per file, and the lookup side has one row per registered path.
    """
    home = packages.groupBy(F.col("path").alias("above")).agg(F.min("identifier").alias("_id"))
    asked = paths.select("path").distinct()
    walked = salted_join(
        asked.select("path", F.posexplode(ancestors(F.col("path"))).alias("_far", "above")),
        home, ["above"], "inner", ["path"],
    )
    nearest = walked.groupBy("path").agg(F.min(F.struct("_far", "_id"))["_id"].alias("package"))
    out = paths.join(nearest, "path", "left")
    return out if explicit is None else out.withColumn("package", F.coalesce(F.col(explicit), F.col("package")))


# -- history ----------------------------------------------------------------


def recent_questions(conversations: DataFrame, n: int) -> DataFrame:
    """The ``n`` newest questions of every package, with ``rank`` 1 for the newest."""
    return top_n(
        conversations.select("package_id", "id", "question", "created_at"),
        ["package_id"], [F.desc("created_at"), F.asc("id")], n, ["id"],
    )


def history(
    conversations: DataFrame,
    packages: DataFrame,
    identifiers: DataFrame,
    now: Column,
    since_days: int | None = None,
    limit: int = DEFAULT_HISTORY,
) -> DataFrame:
    """Newest conversations of the asked ``identifiers(identifier)``, at most ``limit`` each."""
    wanted = packages.join(identifiers.select("identifier").distinct(), "identifier", "left_semi").select(
        F.col("id").alias("package_id"), "identifier"
    )
    rows = conversations
    if since_days is not None:
        rows = rows.where(F.col("created_at") >= now - F.make_dt_interval(days=F.lit(since_days)))
    mine = salted_join(rows, wanted, ["package_id"], "inner", ["id"])
    return top_n(mine, ["identifier"], [F.desc("created_at"), F.asc("id")], limit, ["id"])


def last_activity(conversations: DataFrame) -> DataFrame:
    """Time of the last conversation per package."""
    return conversations.groupBy("package_id").agg(F.max("created_at").alias("last_activity"))


# -- prepared maps ----------------------------------------------------------


def replace_prepared(prepared: DataFrame, new: DataFrame) -> DataFrame:
    """New maps replace the one of their (package, branch); a null branch is a key of its own."""
    both = prepared.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return _latest(both, ["package_id", "git_branch"], ["_new", "created_at", "id"]).drop("_new")


def latest_global(prepared: DataFrame) -> DataFrame:
    """Latest map without a branch per package."""
    return _latest(prepared.where(F.col("git_branch").isNull()), ["package_id"], ["created_at", "id"])


def latest_per_branch(prepared: DataFrame) -> DataFrame:
    """Latest map per (package, branch)."""
    return _latest(prepared.where(F.col("git_branch").isNotNull()), ["package_id", "git_branch"], ["created_at", "id"])


def latest_by_scope(prepared: DataFrame, wants: DataFrame) -> DataFrame:
    """The map each of ``wants(package_id, prepare_scope, branch, ..)`` uses.

    Branch scope with a known branch takes that branch's map and nothing else;
    otherwise the global one is taken. Wants without a map keep nulls.
    """
    latest = _latest(prepared, ["package_id", "git_branch"], ["created_at", "id"])
    maps = latest.select(
        F.col("package_id").alias("_p"), F.col("git_branch").alias("_b"), F.struct(*latest.columns).alias("map")
    )
    key = F.when(F.col("prepare_scope") == "branch", F.col("branch"))
    return (
        wants.withColumn("_want", key)
        .join(maps, (F.col("package_id") == F.col("_p")) & F.col("_want").eqNullSafe(F.col("_b")), "left")
        .drop("_p", "_b", "_want")
    )


# -- retention --------------------------------------------------------------


def package_activity(packages: DataFrame, conversations: DataFrame, prepared: DataFrame) -> DataFrame:
    """Adds ``activity``: latest of registration, conversations and the global map."""
    asked = last_activity(conversations).withColumnRenamed("package_id", "id")
    mapped = (
        prepared.where(F.col("git_branch").isNull())
        .groupBy(F.col("package_id").alias("id")).agg(F.max("created_at").alias("_mapped"))
    )
    return (
        packages.join(asked, "id", "left").join(mapped, "id", "left")
        .withColumn("activity", F.greatest("created_at", "last_activity", "_mapped"))
        .drop("last_activity", "_mapped")
    )


def stale_clones(
    packages: DataFrame, conversations: DataFrame, prepared: DataFrame, clone_dir: str, cutoff: Column
) -> DataFrame:
    """Managed git clones whose every package is older than ``cutoff``.

    One row per member: (path, activity of the whole path, identifier). The path's
    activity is a partial maximum, so a clone that many packages share is not gathered.
    """
    managed = packages.where((F.col("source_type") == "git") & in_scope(F.col("path"), F.lit(clone_dir)))
    active = package_activity(managed, conversations, prepared)
    stale = active.groupBy("path").agg(F.max("activity").alias("activity")).where(F.col("activity") < cutoff)
    return salted_join(managed.select("path", "identifier"), stale, ["path"], "inner", ["identifier"]).select(
        "path", "activity", "identifier"
    )


# -- import of manifests ------------------------------------------------------


def import_status(entries: DataFrame, packages: DataFrame, harnesses: DataFrame) -> DataFrame:
    """Adds ``status`` to manifest entries: skipped (known), failed (unknown harness), added."""
    known = packages.select("identifier", F.lit(True).alias("_have")).distinct()
    allowed = harnesses.select(F.col("name").alias("harness"), F.lit(True).alias("_ok")).distinct()
    status = (
        F.when(F.col("_have"), "skipped")
        .when(F.col("harness").isNotNull() & F.col("_ok").isNull(), "failed")
        .otherwise("added")
    )
    checked = salted_join(entries.join(known, "identifier", "left"), allowed, ["harness"], "left", ["identifier"])
    return checked.withColumn("status", status).drop("_have", "_ok").select(*entries.columns, "status")


def import_tally(statuses: DataFrame) -> DataFrame:
    return statuses.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


# -- prompts ------------------------------------------------------------------

# Wording of the prompt, by map freshness where it depends on it.
INTRO = "You are answering a question about the %s (%s) codebase.\nThe codebase is in your current working directory.\n"
SHALLOW_NOTE = (
    "\nNote: this repository is a shallow clone — its history is truncated (only the tip commit of each branch is present). "
    "If answering requires git history, blame, or a version other than the current branch tip, you have permission to deepen it "
    "yourself by running `git fetch --unshallow` (or `git fetch --deepen=N`) inside the repository before proceeding.\n"
)
MAP_BEGIN = "\n--- BEGIN PREPARED ORIENTATION MAP ---\n"
MAP_END = "--- END PREPARED ORIENTATION MAP ---\n"
MAP_HEADER = "Prepared at %s on commit `%s` (current HEAD `%s`%s). Scope: `%s`\n"
DIRECTIVE = {
    FRESH: "This is an accurate, authoritative orientation for this exact codebase. Rely on it instead of re-deriving structure.\n",
    SLIGHTLY_STALE: "This orientation map was accurate a few commits ago and is still a reliable guide to where things live; "
    "rely on it but expect minor drift in recently changed areas.\n",
    UNKNOWN: "This orientation map may be out of date. Use it as a guide to where things live, not as ground truth — "
    "verify specifics before relying on them.\n",
}
QUESTIONS = "\nRecent questions asked about this package (for context, avoid re-exploring these topics):\n"
CLOSING = {
    None: "Explore the codebase and answer precisely. Reference file paths.",
    FRESH: "Treat the prepared orientation map above as the authoritative primary source. Do NOT perform a broad tree scan: "
    "answer directly from the map, opening only files it points to or that are strictly necessary to answer. Reference file paths.",
    SLIGHTLY_STALE: "Treat the prepared orientation map above as the authoritative primary source. Do NOT perform a broad tree scan: "
    "trust the map's structure, but it is a few commits behind — additionally verify only the specific files plausibly affected by "
    "recent changes. Open only files the map points to or that are strictly necessary to answer. Reference file paths.",
    UNKNOWN: "The prepared orientation map above may be stale. Use it as a starting guide, but explore the codebase to verify and "
    "answer precisely. Reference file paths.",
}


def rfc3339(ts: Column) -> Column:
    """UTC time with as many fraction digits as it needs (0, 3 or 6)."""
    micros = F.pmod(F.unix_micros(ts), F.lit(1000000))
    digits = F.lpad(micros.cast("string"), 6, "0")
    fraction = (
        F.when(micros == 0, "").when(F.pmod(micros, F.lit(1000)) == 0, F.concat(F.lit("."), F.substring(digits, 1, 3)))
        .otherwise(F.concat(F.lit("."), digits))
    )
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit("+00:00"))


def assemble_prompts(
    asks: DataFrame,
    packages: DataFrame,
    conversations: DataFrame,
    prepared: DataFrame,
    context: int = 0,
    toolkit: str | None = None,
) -> DataFrame:
    """Prompt text for ``asks(ask_id, identifier, question, branch, current_commit, behind)``.

    Joins the package, its map by scope, and its ``context`` newest questions (so
    at most that many are ever gathered). ``toolkit`` is an optional block of text.
    """
    pkg = packages.select(
        "identifier", F.col("id").alias("package_id"), "display_name", "shallow", "prepare_scope"
    )
    wants = salted_join(asks, pkg, ["identifier"], "inner", ["ask_id"])
    rows = latest_by_scope(prepared, wants)
    if context > 0:
        # Only packages that are asked about need their history ranked.
        needed = wants.select("package_id").distinct()
        recent = recent_questions(
            salted_join(conversations, needed, ["package_id"], "left_semi", ["id"]), context
        ).groupBy("package_id").agg(
            F.transform(
                F.array_sort(F.collect_list(F.struct("rank", "question"))), lambda q: F.concat(F.lit("- "), q["question"], F.lit("\n"))
            ).alias("_recent")
        )
        rows = salted_join(rows, recent, ["package_id"], "left", ["ask_id"])
    else:
        rows = rows.withColumn("_recent", F.lit(None).cast("array<string>"))

    has_map = F.col("map").isNotNull()
    fresh = freshness(F.col("behind"))
    by_freshness = lambda texts: (
        F.when(fresh == FRESH, texts[FRESH]).when(fresh == SLIGHTLY_STALE, texts[SLIGHTLY_STALE]).otherwise(texts[UNKNOWN])
    )
    lag = F.when(F.col("behind") > 0, F.format_string(", %d commits behind", F.col("behind"))).otherwise("")
    header = F.format_string(
        MAP_HEADER, rfc3339(F.col("map.created_at")), F.coalesce("map.git_commit_sha", F.lit("unknown")),
        F.coalesce("current_commit", F.lit("unknown")), lag, F.col("map.prepare_scope_at_time"),
    )
    content = F.col("map.content")
    block = F.concat(
        F.lit(MAP_BEGIN), by_freshness(DIRECTIVE), header, content,
        F.when(F.endswith(content, F.lit("\n")), "").otherwise("\n"), F.lit(MAP_END),
    )
    recent_block = F.concat(F.lit(QUESTIONS), F.array_join("_recent", ""), F.lit("\n"))
    closing = F.when(has_map, by_freshness(CLOSING)).otherwise(CLOSING[None])
    prompt = F.concat(
        F.format_string(INTRO, "display_name", "identifier"),
        F.when(F.col("shallow"), SHALLOW_NOTE).otherwise(""),
        F.when(has_map, block).otherwise(""),
        F.when(F.size("_recent") > 0, recent_block).otherwise(""),
        F.lit(toolkit or ""),
        F.lit("\nQuestion: "), F.col("question"), F.lit("\n\n"), closing, F.lit("\n"),
    )
    return rows.select("ask_id", "identifier", prompt.alias("prompt"))
