"""K-means on whole numbers, by dot products that are kept per vector and changed only where a centroid changed."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslens.session import cut

CENTROIDS = 16
ROUNDS = 3
SCALE = 64
WIDEST = 1 << 27  # largest component in magnitude: with 64 of them every distance is a long


def whole(rows: DataFrame, vector: str, size: int, scale: int = SCALE) -> DataFrame:
    """Kept rows with ``x``, the vector in whole numbers: ``size`` components, none null or non-finite."""
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    wide = F.concat(F.lit("a component is too wide for distances in whole numbers: "), v.cast("string"))
    number = lambda x: F.floor(F.lit(scale) * x.cast("double"))
    narrow = F.forall(v, lambda x: F.abs(F.floor(F.lit(float(scale)) * x.cast("double"))) <= WIDEST)
    kept = rows.where(F.coalesce((F.size(v) == size) & fine, F.lit(False)))
    return kept.withColumn("x", F.when(narrow, F.transform(v, lambda x: number(x).cast("int"))).otherwise(F.raise_error(wide)))


def starts(kept: DataFrame, key: str, count: int, salt: str) -> list[list[int]]:
    """The vectors whose ``salt:key`` has the smallest hashes; ``count`` rows reach the driver."""
    mark = F.sha2(F.concat(F.lit(f"{salt}:"), F.col(key).cast("string")), 256)
    first = kept.select(mark.alias("mark"), "x").orderBy(F.asc_nulls_last("mark"), "x").limit(count)
    return [list(r.x) for r in first.collect()]


def _matrix(column: pa.Array, width: int, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, width)


def _list(values: np.ndarray) -> pa.ListArray:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * width, width), pa.int32()), pa.array(values.reshape(-1)))


def _moved(batches: Iterator[pa.RecordBatch], width: int, centroids: np.ndarray, change: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Dot products after each centroid moved by its row of ``change``, and the nearest centroid then.

    Without ``dots`` yet they are zero and the change is the centroid itself, so both cases are one."""
    squares = (centroids * centroids).sum(1)
    steps = [(c, np.flatnonzero(change[c])) for c in range(len(change))]
    for batch in batches:
        names = batch.schema.names
        x = _matrix(batch.column(names.index("x")), width, np.int64)
        old = "dots" in names
        dots = _matrix(batch.column(names.index("dots")), len(centroids), np.int64) if old else np.zeros((len(x), len(centroids)), np.int64)
        for c, at in steps:
            if len(at):
                dots[:, c] += x[:, at] @ change[c, at]
        score = squares - 2 * dots  # the squared distance but for the vector's own square
        best = score.argmin(1)  # the first of equals
        far = np.take_along_axis(score, best[:, None], 1)[:, 0] + (x * x).sum(1)
        was = batch.column(names.index("cluster")) if old else pa.nulls(len(x), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [batch.column(names.index("vec_id")), batch.column(names.index("x")), _list(dots), pa.array(best.astype(np.int32)), was, pa.array(far)],
            ["vec_id", "x", "dots", "cluster", "was", "distance"])


def _sums(batches: Iterator[pa.RecordBatch], width: int, count: int) -> Iterator[pa.RecordBatch]:
    """What the rows that changed their cluster add to each cluster's count and component sums, once per partition."""
    total, n = np.zeros((count, width), np.int64), np.zeros(count, np.int64)
    for batch in batches:
        x = _matrix(batch.column(batch.schema.names.index("x")), width, np.int64)
        now = batch.column(batch.schema.names.index("cluster")).to_numpy()
        was = batch.column(batch.schema.names.index("was")).fill_null(-1).to_numpy(zero_copy_only=False)
        np.add.at(total, now, x)
        np.add.at(n, now, 1)
        left = was >= 0
        np.subtract.at(total, was[left], x[left])
        np.subtract.at(n, was[left], 1)
    some = np.flatnonzero((n != 0) | total.any(1))
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some]), _list(total[some])], ["cluster", "n", "sums"])


def cluster(rows: DataFrame, size: int, key: str = "vec_id", vector: str = "embedding", count: int = CENTROIDS, rounds: int = ROUNDS, salt: str = "1", scale: int = SCALE) -> DataFrame:
    """(vec_id, x, cluster, distance, cluster_inertia, inertia, centroid) for each kept row of ``rows``.

    A vector is kept with exactly ``size`` components, none null or non-finite; component v becomes floor(scale * v).
    Centroids start as the ``count`` kept vectors of smallest hash, and every round assigns each vector to the nearest
    (squared distance, ties to the smaller number), then puts each centroid with vectors at floor(sum / count).

    The table of dot products is made once and written anew each round with only the changes: a centroid's new dot
    product is the old one plus the vector's components where the centroid moved, times those moves. The distance's order is
    |c|^2 - 2 x.c, exact in longs. Sums change only by vectors that changed their cluster, added up per partition
    and by Spark; ``count`` rows of sums reach the driver each round. Rounds end early when no centroid moves.

    Repeated rows count as often as they stand there; equal keys are ordered by their vectors when centroids are chosen. A null
    key takes part and starts a centroid only after all others. With fewer kept rows than ``count`` each is a centroid; none give
    an empty result. Other columns are ignored. Components beyond ``WIDEST`` raise an error, as distances would be no
    longs; a sum of distances that is no long is null.
    """
    kept = whole(rows.select(F.col(key).alias("vec_id"), F.col(vector).alias("_v")), "_v", size, scale).select("vec_id", "x")
    first = starts(kept, "vec_id", count, salt)
    ends = T.StructType([*kept.schema.fields]).add("dots", T.ArrayType(T.LongType())).add("cluster", "integer").add("was", "integer").add("distance", "long")
    centroids = np.array(first, np.int64).reshape(-1, size)
    n = len(centroids)
    totals, counts = np.zeros((n, size), object), [0] * n
    state = kept
    change = centroids
    for done in range(rounds + 1):
        state, _ = cut(state.mapInArrow(lambda b, c=centroids, m=change: _moved(b, size, c, m), ends), "dots")
        if done == rounds or not n:
            break
        moves = state.where("was is null or was <> cluster").select("x", "cluster", "was")
        parts = moves.mapInArrow(lambda b: _sums(b, size, n), "cluster int, n bigint, sums array<bigint>")
        exact = lambda c: F.sum(c.cast("decimal(38,0)"))
        for r in parts.groupBy("cluster").agg(exact(F.col("n")).alias("n"), F.array(*(exact(F.col("sums")[j]) for j in range(size))).alias("sums")).collect():
            counts[r.cluster] += int(r.n)
            totals[r.cluster] += [int(s) for s in r.sums]
        new = np.array([[int(s) // c for s in t] if c else old for t, c, old in zip(totals, counts, centroids.tolist(), strict=True)], np.int64)
        change, centroids = new - centroids, new
        if not change.any():
            break
    return _described(state, centroids)


def _described(state: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Each vector with its cluster's and all clusters' inertia and its centroid; one row per cluster reaches the driver."""
    sums = {r.cluster: int(r.s) for r in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    fits = lambda s: F.lit(s if s < 1 << 63 else None).cast("long")
    of = F.array(*(fits(sums.get(c, 0)) for c in range(len(centroids)))).cast("array<bigint>")
    at = F.array(*(F.array(*map(F.lit, c)) for c in centroids.tolist())).cast("array<array<bigint>>")
    return state.select(
        "vec_id", "x", "cluster", "distance", F.get(of, F.col("cluster")).alias("cluster_inertia"),
        fits(sum(sums.values())).alias("inertia"), F.get(at, F.col("cluster")).alias("centroid"))


def digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


# The same by whole distances, for three rounds of 16 centroids on 64 components.
_NEAREST = """SELECT k.rid, min({{'d': list_sum(list_transform(list_zip(k.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'c': c.c}}) AS best
      FROM kept k, c{0} c GROUP BY k.rid"""
_MEANS = """SELECT c.c, coalesce(m.v, c.v) AS v FROM c{0} c LEFT JOIN (
      SELECT c, list(m ORDER BY j) AS v FROM (
        SELECT c, j, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS m FROM (
          SELECT c, j, sum(x) AS s, count(*) AS n FROM (
            SELECT a.best.c AS c, unnest(k.v) AS x, generate_subscripts(k.v, 1) AS j FROM a{0} a JOIN kept k USING (rid))
          GROUP BY c, j)) GROUP BY c) m USING (c)"""


def sql(size: int, count: int = CENTROIDS, rounds: int = ROUNDS, salt: str = "1", scale: int = SCALE) -> str:
    """DuckDB SQL for the digests of :func:`cluster`, by all distances and whole sums in each round."""
    steps = [f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id,
      list_transform(embedding, lambda x: CAST(floor({float(scale)} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
      FROM embeddings WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {size})""",
             f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{salt}:' || vec_id) NULLS LAST, v) - 1 AS c, v
      FROM kept ORDER BY c LIMIT {count})"""]
    for r in range(rounds):
        steps += [f"a{r} AS MATERIALIZED ({_NEAREST.format(r)})", f"c{r + 1} AS MATERIALIZED ({_MEANS.format(r)})"]
    steps.append(f"a{rounds} AS MATERIALIZED ({_NEAREST.format(rounds)})")
    return "WITH " + ",\n".join(steps) + f"""
    SELECT k.vec_id, CAST(a.best.c AS INTEGER) AS cluster, CAST(a.best.d AS BIGINT) AS distance,
      CAST(sum(a.best.d) OVER (PARTITION BY a.best.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.best.d) OVER () AS BIGINT) AS inertia,
      sha256(array_to_string(c.v, ',')) AS centroid_sha256
    FROM kept k JOIN a{rounds} a USING (rid) JOIN c{rounds} c ON c.c = a.best.c"""
