"""What the operators on vectors share: usable rows, matrices, bounded samples, blocks of candidate groups."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 1024  # rows of one side that a task compares at a time


def usable(vector: Column) -> Column:
    """Not null, not all zero, and every component a finite number."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Equally long vectors as rows, in double precision."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def sample(rows: DataFrame, vector: str, most: int, total: int) -> dict[int, np.ndarray]:
    """Up to about ``most`` vectors, the same at each run, as a matrix for each length that occurs."""
    share = int((1 << 30) * min(1.0, most / max(total, 1)))
    got = rows.where(F.pmod(F.xxhash64(vector), F.lit(1 << 30)) < share).select(vector).toArrow().column(0)
    by: dict[int, list[list[float]]] = {}
    for v in got.to_pylist():
        by.setdefault(len(v), []).append(v)
    return {n: np.array(sorted(vs), np.float64) for n, vs in by.items()}


def blocked(held: DataFrame, asked: DataFrame, keys: list[str], spread: str, block: int = BLOCK) -> DataFrame:
    """Both sides of each group of ``keys`` in blocks, as rows of (keys, i, j, side, other columns), grouped and sorted.

    Rows of ``held`` (side 0) and of ``asked`` (side 1) with equal keys meet in one (keys, i, j) each. Blocks have about ``block``
    rows of either side, so a group that holds a large share of all rows is many groups; ``spread`` is a column that deals rows.
    """
    parts = []
    for side, df in enumerate((held, asked)):
        sizes = df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(f"parts{side}"))
        parts.append(sizes)
    sizes = parts[0].join(parts[1], keys)
    out = []
    for side, df in enumerate((held, asked)):
        mine, theirs = ("i", "j") if side == 0 else ("j", "i")
        rows = df.join(sizes, keys).withColumn(mine, F.pmod(F.xxhash64(spread), f"parts{side}").cast("int"))
        rows = rows.withColumn(theirs, F.explode(F.sequence(F.lit(0), F.col(f"parts{1 - side}") - 1)))
        out.append(rows.select(*keys, "i", "j", F.lit(side).alias("side"), *(c for c in df.columns if c not in keys)))
    both = out[0].unionByName(out[1])
    order = [*keys, "i", "j"]
    return both.repartition(*order).sortWithinPartitions(*order, "side")
