"""Joins and per-key limits that hold when one key owns a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuslens.session import cut

SALTS = 16
DEFAULT_BUDGET = 16384  # bytes of one answer
_SALT = "_salt"


def salt_of(columns: Sequence[str | Column], salts: int = SALTS) -> Column:
    """Deterministic salt in ``[0, salts)``, the same on every retry of a task."""
    return F.pmod(F.xxhash64(*columns), F.lit(salts)).cast("int")


def salted_join(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    how: str,
    spread: Sequence[str],
    salts: int = SALTS,
) -> DataFrame:
    """Join where one key may hold much of ``big``; ``small`` is a list of requests or keys.

    ``big`` is spread over ``salts`` sub-keys by the columns ``spread`` and every row
    of ``small`` is repeated once per sub-key, so a hot key becomes ``salts`` tasks.
    ``how`` keeps ``big`` whole or filters it: inner, left, left_semi, left_anti.
    Nothing is hinted: when ``small`` with its copies really is small Spark broadcasts it by its
    size and the salt costs nothing but a hash. The copies come from a cross join, whose size Spark
    multiplies; an exploded column counts as one row, and sixteen times the list would be sent.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"cannot salt a {how} join")
    left = big.withColumn(_SALT, salt_of(list(spread), salts))
    right = small.crossJoin(small.sparkSession.range(salts).select(F.col("id").cast("int").alias(_SALT)))
    return left.join(right, [*on, _SALT], how).drop(_SALT)


def top_n(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    n: int,
    spread: Sequence[str],
    rank: str = "rank",
    salts: int = SALTS,
) -> DataFrame:
    """First ``n`` rows of each key under a total ``order``, with their ``rank``.

    Ranked inside (key, salt) first: a row outside the first ``n`` of its own share
    cannot be among the first ``n`` of the key, so the last window sees at most
    ``n * salts`` rows per key. Spark also limits each map task before either shuffle.
    """
    part = W.partitionBy(*keys, _SALT).orderBy(*order)
    whole = W.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn(_SALT, salt_of(list(spread), salts))
        .withColumn(rank, F.row_number().over(part))
        .where(F.col(rank) <= n)
        .drop(rank, _SALT)
        .withColumn(rank, F.row_number().over(whole))
        .where(F.col(rank) <= n)
    )


def ranked(df: DataFrame, order: Sequence[str | Column], rank: str = "rank") -> DataFrame:
    """``df`` with its ``rank`` from 1 under a total ``order`` over all rows.

    Rows are dealt by ranges of the order and sorted inside; a row's rank is its place in its range, after the sizes of the
    ranges before it. No task sees all rows; what is added up in one place is one number per range. Rows are written
    once, so that places and sizes agree also where a lost task runs again.
    """
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    rows, _ = cut(spread, "ranked")
    # The identifier holds the range in its upper bits and the place in the lower 33.
    part = F.shiftright("_at", 33)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    starts, _ = cut(sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before")), "starts")
    place = F.col("_at") - F.shiftleft(part, 33)
    return rows.withColumn("_part", part).join(starts, "_part").withColumn(rank, F.col("_before") + place + 1).drop("_part", "_at", "_before")


def byte_budget(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    spread: Sequence[str],
    budget: int = DEFAULT_BUDGET,
    size: Column | None = None,
    salts: int = SALTS,
) -> DataFrame:
    """Keep each answer's rows, in order, while their running size fits ``budget`` bytes.

    ``size`` defaults to the row's JSON length. Adds ``used_bytes`` (running total)
    and ``truncated`` (whether the answer lost any row). Only a row's share of the
    running sum is needed to rule it out, so shares are cut first; the first row
    over the budget of each share stays until the final sum, which makes the cut exact.
    """
    size = F.octet_length(F.to_json(F.struct(*df.columns))) if size is None else size
    part = W.partitionBy(*keys, _SALT).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    sized = df.withColumn("_size", size.cast("long")).withColumn(_SALT, salt_of(list(spread), salts))
    return (
        sized.withColumn("_part", F.sum("_size").over(part))
        .where(F.col("_part") - F.col("_size") <= budget)
        .withColumn("used_bytes", F.sum("_size").over(whole))
        # Sizes are never negative, so an answer is cut exactly when its pruned
        # total passes the budget.
        .withColumn("_total", F.sum("_size").over(W.partitionBy(*keys)))
        .withColumn("truncated", F.col("_total") > budget)
        .where(F.col("used_bytes") <= budget)
        .drop("_size", "_part", "_total", _SALT)
    )
