"""What several operators share: table reading, hashing of whole texts in Arrow batches, components of a graph."""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuslens.session import cut, tune

SLICE = 1 << 20  # bytes of text that are hashed at a time; a longer document is cut at white space


_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Give the executors this package, by Spark's own file service, once per application; small Arrow batches."""
    context = spark.sparkContext
    # Rows hold whole texts: few to a batch keep executors and their Python workers small.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    if context.applicationId not in _shipped:
        top = Path(__file__).resolve().parents[1]
        # Only the driver reads this file; Spark serves it to executors for as long as the application lives.
        folder = tempfile.mkdtemp(prefix="spark-package-")
        context.addPyFile(shutil.make_archive(f"{folder}/{top.name}", "zip", top.parent, top.name))
        _shipped.add(context.applicationId)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(ship(spark)).read.parquet(f"{sf_dir}/{name}.parquet")


LISTED = 500_000  # short rows (ids, pairs, a few numbers) that are broadcast at most; more are joined by a shuffle


def listed(df: DataFrame, name: str, count: Column | None = None) -> DataFrame:
    """``df`` written and read back, marked for broadcast only where its counted rows (or the sum ``count``) are at most ``LISTED``.

    Texts need not move then; beyond that size the join shuffles both sides."""
    rows, n = cut(df, name, count)
    return F.broadcast(rows) if n <= LISTED else rows


# -- hashing ------------------------------------------------------------------

_rng = np.random.default_rng(20240229)
_ODD = np.uint64(int(_rng.integers(1 << 62, 1 << 63)) * 2 + 1)
_BACK = np.uint64(pow(int(_ODD), -1, 1 << 64))
_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_CODE[ord("A"): ord("Z") + 1] = _CODE[ord("a"): ord("z") + 1]  # lower-cases A-Z only
_EXACT = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit words, so that any of them can be used alone."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS = np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(SLICE, _ODD, np.uint64))])
_UNPOWERS = np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(SLICE, _BACK, np.uint64))])


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n < len(_POWERS):
        return _POWERS[: n + 1], _UNPOWERS[: n + 1]
    one = np.ones(1, np.uint64)  # a single word longer than a slice
    return tuple(np.concatenate([one, np.multiply.accumulate(np.full(n, p, np.uint64))]) for p in (_ODD, _BACK))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, exact: bool = False) -> np.ndarray:
    """64-bit hash of each byte span; without ``exact``, A-Z counts as a-z."""
    up, down = _powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_EXACT if exact else _CODE)[data] * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def _pieces(data: np.ndarray) -> Iterator[np.ndarray]:
    at = 0
    while len(data) - at > SLICE:
        gaps = np.flatnonzero(SPACE[data[at: at + SLICE]])
        if len(gaps):
            end = at + int(gaps[-1]) + 1
        else:
            more = np.flatnonzero(SPACE[data[at + SLICE:]])
            end = at + SLICE + (int(more[0]) + 1 if len(more) else len(data) - at - SLICE)
        yield data[at:end]
        at = end
    yield data[at:]


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` of each text, A-Z lower-cased, and where each text's words begin."""
    if len(offsets) == 2 and len(data) > SLICE:
        parts = [words_of(p, np.array([0, len(p)]))[0] for p in _pieces(data)]
        return (w := np.concatenate(parts)), np.array([0, len(w)])
    starts, ends = word_spans(data, offsets)
    return span_hashes(data, starts, ends), np.searchsorted(starts, offsets)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of each word; no word reaches over the end of its text."""
    inside = ~SPACE[data]
    begin, last = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = offsets[:-1][np.diff(offsets) > 0]
    begin[edge] = inside[edge]
    last[edge[1:] - 1] = inside[edge[1:] - 1]
    return np.flatnonzero(begin), np.flatnonzero(last) + 1


def texts(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) for runs of rows of about ``SLICE`` bytes; null counts as empty."""
    import pyarrow.compute as pc

    values = pc.fill_null(batch.column(batch.schema.get_field_index(column)), "").cast(pa.large_string())
    n = len(values)
    offsets = np.frombuffer(values.buffers()[1], np.int64, n + 1 + values.offset)[values.offset:] if n else np.zeros(1, np.int64)
    raw = values.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, "right")) - 1)
        yield at, data[offsets[at]: offsets[end]], offsets[at: end + 1] - offsets[at]
        at = end


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of the neighbouring rows with equal ``keys`` (whole numbers), also over the borders of batches."""
    rest: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        at = np.stack([t.column(k).to_numpy() for k in keys])
        edges = np.concatenate([[0], np.flatnonzero((at[:, 1:] != at[:, :-1]).any(axis=0)) + 1, [t.num_rows]])
        if rest and any(rest[0].column(k)[0] != t.column(k)[0] for k in keys):
            yield pa.concat_tables(rest)
            rest = []
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            rest.append(t.slice(lo, hi - lo))
            if hi < t.num_rows:
                yield pa.concat_tables(rest)
                rest = []
    if rest:
        yield pa.concat_tables(rest)


def longs(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def lists(values: np.ndarray, bounds: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values))


# -- graphs -------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of undirected ``edges`` (a, b); a component is its smallest node.

    Alternates large and small stars: each node's greater neighbours, then its smaller
    ones, are tied to the least node next to it, until nothing moves. Edges stay as
    few as they were and rounds grow with the logarithm of the longest path. Every
    round is a written table, so a lost executor repeats tasks only.
    """
    links = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b")
    before, mark = None, F.sum(F.shiftright(F.xxhash64("a", "b"), 20))
    while True:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b")
        low = large.withColumn("m", F.min("b").over(W.partitionBy("a")))
        ties = F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))))
        small = low.select(ties.alias("t")).select("t.a", "t.b").where("a > b").distinct()
        links, now = cut(small, "links", mark)
        if now == before or not now:
            break
        before = now
    tops = links.groupBy("a").agg(F.min("b").alias("component"))
    return tops.select(F.col("a").alias("node"), "component").union(
        links.select("b").distinct().join(tops, F.col("b") == F.col("a"), "left_anti").select("b", "b"))
