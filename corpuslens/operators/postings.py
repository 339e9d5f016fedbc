"""Posting tables on disk: words and letter triples to the files that hold them, and search by them.

A posting table is cut into slots by the hash of its key, each a folder, so a lookup opens the folder of its key and no
other; inside, rows are in order of the key, which lets row-group statistics prune the rest. Rows are dealt by slot and
adaptive execution splits what is too big by its measured size, so a key with very many files is many tasks and files.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.functions.text import fold_ascii
from corpuslens.operators.search import search
from corpuslens.session import cut

FILE = ["root_path", "file_path"]
SLOTS = 64


def _slot(key: Column, slots: Column) -> Column:
    return F.pmod(F.xxhash64(key), slots).cast("int")


def write_postings(rows: DataFrame, path: str, slots: int = SLOTS) -> None:
    """Write ``rows(key, root_path, file_path, ..)``; the number of slots is a folder's name, so readers need not know it."""
    keyed = rows.withColumn("slots", F.lit(slots)).withColumn("slot", _slot(F.col("key"), F.lit(slots)))
    # Rebalanced, not dealt by ranges: ranges are found by a sample, for which the texts would be worked through once more.
    keyed.hint("rebalance", "slot").sortWithinPartitions("slots", "slot", "key", *FILE).write.partitionBy("slots", "slot").parquet(path)


def read_postings(spark: SparkSession, path: str, keys: Iterable[str]) -> DataFrame:
    """Rows of the given keys; only the folders of their slots are read."""
    stored = spark.read.parquet(path)
    keys = sorted(set(keys))
    of_slot = F.lit(False)
    for k in keys:
        of_slot = of_slot | (F.col("slot") == _slot(F.lit(k), F.col("slots")))
    return stored.where(of_slot).where(F.col("key").isin(keys)).drop("slots", "slot")


def word_postings(identifiers: DataFrame) -> DataFrame:
    """Postings of an identifier relation, by A-Z folded token, so that lookups can fold or not."""
    return identifiers.select(fold_ascii(F.col("token")).alias("key"), *FILE, "line", "token")


def word_hits(spark: SparkSession, path: str, word: str, ignore_case: bool = False) -> DataFrame:
    """Lines that hold ``word``, from :func:`word_postings` written at ``path``."""
    lower = "".join(c.lower() if c.isascii() else c for c in word)
    rows = read_postings(spark, path, [lower]).select(*FILE, "line", "token")
    return rows if ignore_case else rows.where(F.col("token") == word)


def gram_postings(files: DataFrame) -> DataFrame:
    """(key, file) for every three neighbouring signs of each text, A-Z folded, once per file."""
    text = fold_ascii(F.col("content"))
    # Each start in turn, which needs no look-ahead at every sign.
    grams = F.concat(*(F.regexp_extract_all(F.substr(text, F.lit(start)), F.lit("(?s)..."), F.lit(0)) for start in (1, 2, 3)))
    return files.select(F.explode_outer(F.array_distinct(grams)).alias("key"), *FILE).where("key is not null")


def required_grams(pattern: str) -> set[str] | None:
    """Triples, A-Z folded, that every match of the pattern holds; None where the pattern does not tell.

    Only plain signs outside groups and classes count, and only those that no quantifier can drop. Alternatives,
    flags other than a leading ``(?i)``, quotes, look-arounds and escapes by number say nothing: then the answer is None.
    """
    p = pattern.removeprefix("(?i)")
    if "|" in p or r"\Q" in p or re.search(r"\(\?(?!:)", p):
        return None
    runs, run, i = [], "", 0

    def end() -> None:
        nonlocal run
        runs.append(run)
        run = ""

    def closed(at: int, opens: str, closes: str) -> int:
        """Place after the bracket that closes the one at ``at``."""
        depth, inside = 0, False
        while at < len(p):
            c = p[at]
            if c == "\\":
                at += 1
            elif opens == "(" and c in "[]":
                if c == "[":
                    at = closed(at, "[", "]") - 1
            elif c == opens:
                depth += 1
                # A closing bracket right after the opening one is a sign of the class.
                if opens == "[" and p[at + 1: at + 2] in ("]", "^") and not inside:
                    at += 2 if p[at + 1: at + 3] == "^]" else 1
                inside = True
            elif c == closes:
                depth -= 1
                if not depth:
                    return at + 1
            at += 1
        return at

    while i < len(p):
        c, sign = p[i], None
        if c == "\\":
            n = p[i + 1: i + 2]
            if n in ("p", "P"):
                i = p.index("}", i) + 1 if p[i + 2: i + 3] == "{" else i + 3
                end()
            elif n.isalnum():
                if n not in "dDwWsSbBhHvVAzZRtnrf":
                    return None
                i += 2
                end()
            else:
                sign, i = n, i + 2
        elif c == "[":
            i = closed(i, "[", "]")
            end()
        elif c == "(":
            i = closed(i, "(", ")")
            end()
        elif c in ".^$":
            i += 1
            end()
        else:
            sign, i = c, i + 1
        if sign is not None:
            run += sign
        q = re.match(r"(?:[?*+]|\{[^}]*\})[?+]?", p[i:])
        if q:
            if sign is not None and q[0][0] != "+":
                run = run[:-1]
            i += q.end()
            end()
    end()
    fold = lambda s: "".join(c.lower() if c.isascii() else c for c in s)
    grams = {fold(r[k: k + 3]) for r in runs for k in range(len(r) - 2)}
    return grams or None


def search_indexed(files: DataFrame, path: str, pattern: str, context: int = 0, ignore_case: bool = False) -> DataFrame:
    """The same rows as :func:`search`, from the files that :func:`gram_postings` written at ``path`` leaves.

    Files that lack a triple which every match needs are not searched. A pattern without such triples searches all. The names
    left are written first, so that by their true size Spark can send them to where the texts are.
    """
    grams = required_grams(pattern)
    if grams is not None:
        held = read_postings(files.sparkSession, path, grams).groupBy(*FILE).agg(F.count_distinct("key").alias("_n"))
        names, _ = cut(held.where(F.col("_n") == len(grams)).select(*FILE), "near")
        files = files.join(names, FILE, "left_semi")
    return search(files, pattern, context, ignore_case)
