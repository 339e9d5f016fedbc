"""Regex line search with context, on the file row: text is never shuffled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.functions.paths import matches_glob
from corpuslens.functions.text import split_lines

DEFAULT_CONTEXT = 2


def _narrow(files: DataFrame, language: str | None, globs: tuple[str, ...]) -> DataFrame:
    if language is not None:
        files = files.where(F.col("language") == language)
    kept = None
    for glob in (g for g in globs if not g.startswith("!")):
        test = matches_glob(F.col("file_path"), glob)
        kept = test if kept is None else kept | test
    if kept is not None:
        files = files.where(kept)
    for glob in (g for g in globs if g.startswith("!")):
        files = files.where(matches_glob(F.col("file_path"), glob))
    return files


def search(
    files: DataFrame,
    pattern: str,
    context: int = DEFAULT_CONTEXT,
    ignore_case: bool = False,
    language: str | None = None,
    globs: tuple[str, ...] = (),
) -> DataFrame:
    """One row per matching line: its line, 1-based byte column, text, and context arrays.

    ``before`` and ``after`` hold the non-matching lines within ``context`` lines, in
    line order. Each line is searched by itself, where its file was read, and context comes
    from the file's own line array, so there is no join and no shuffle.
    """
    regex = f"(?i){pattern}" if ignore_case else pattern
    hits = (
        _narrow(files, language, globs)
        .select("root_path", "file_path", split_lines(F.col("content")).alias("_lines"))
        .select(
            "root_path", "file_path", "_lines",
            F.transform("_lines", lambda x: x.rlike(regex)).alias("_hit"),
        )
        .where(F.exists("_hit", lambda hit: hit))
    )
    rows = hits.select(
        "root_path", "file_path", "_lines", "_hit", F.posexplode("_hit").alias("_pos", "_match")
    ).where("_match")
    text = F.element_at("_lines", F.col("_pos") + 1)
    start = F.regexp_instr(text, F.lit(regex))

    def around(low, high):
        near = F.when(
            low <= high,
            F.transform(
                F.sequence(low, high),
                lambda n: F.struct(
                    n.alias("line"),
                    F.element_at("_lines", n).alias("text"),
                    F.element_at("_hit", n).alias("hit"),
                ),
            ),
        )
        kept = F.filter(F.coalesce(near, F.array()), lambda x: ~x["hit"])
        return F.transform(kept, lambda x: F.struct(x["line"].alias("line"), x["text"].alias("text")))

    line = F.col("_pos") + 1
    out = rows.select(
        "root_path", "file_path", line.alias("line"),
        (F.octet_length(F.substr(text, F.lit(1), start - 1)) + 1).cast("long").alias("column"),
        text.alias("text"),
        *(
            [
                around(F.greatest(line - context, F.lit(1)), line - 1).alias("before"),
                around(line + 1, F.least(line + context, F.size("_lines"))).alias("after"),
            ]
            if context > 0
            else []
        ),
    )
    return out


def context_rows(matches: DataFrame) -> DataFrame:
    """Search results as plain rows: each match with its context lines, by ``offset``."""
    whole = F.concat("before", F.array(F.struct("line", "text")), "after")
    return matches.select(
        "root_path", "file_path", F.col("line").alias("match_line"), F.explode(whole).alias("_c")
    ).select(
        "root_path", "file_path", "match_line",
        F.col("_c.line").alias("line"), F.col("_c.text").alias("text"),
        (F.col("_c.line") - F.col("match_line")).alias("offset"),
    )
