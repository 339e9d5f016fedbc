"""Nearest neighbours by balanced posting lists, with centroids searched by a graph in memory."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuslens.llm.common import runs
from corpuslens.llm.multi_index import distances
from corpuslens.llm.vectors import blocked, matrix, sample, usable
from corpuslens.session import cut
from corpuslens.skew import top_n

NEAREST = 20
SAMPLE = 16_384  # vectors that lists and the ratio are fitted on, at most
LISTS = 4096  # posting lists, at most
CLOSURE = 0.10  # a vector is also held by lists this much further than its nearest
COPIES = 4  # lists that hold one vector, at most
SPREAD = 0.5  # chosen lists are apart by this share of the vector's distance at least
TARGET = 0.965  # share of the sample's neighbours that the distance ratio has to reach
DEGREE = 16  # neighbours of a centroid in the graph


@dataclass
class Lists:
    """Centroids in the space with one more dimension, their graph, and the ratio that selects lists."""

    centroids: np.ndarray
    graph: np.ndarray
    longest: float
    ratio: float = 1.0

    def lifted(self, x: np.ndarray) -> np.ndarray:
        """Vectors made equally long by one more component: the nearest then have the largest inner product."""
        rest = np.sqrt(np.maximum(self.longest**2 - (x * x).sum(1), 0))
        return np.hstack([x, rest[:, None]])

    def asked(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([x / np.linalg.norm(x, axis=1)[:, None] * self.longest, np.zeros((len(x), 1))])

    def walk(self, q: np.ndarray, ratio: float) -> list[tuple[float, int]]:
        """(distance, list) within ``ratio`` of the nearest: best first over the graph, until only further ones are open."""
        start = len(self.centroids) // 2
        d = float(np.sqrt(((self.centroids[start] - q) ** 2).sum()))
        heap, seen, best, out = [(d, start)], {start}, d, []
        slack = 1.02  # goes on a little beyond, past local minima
        while heap:
            d, c = heappop(heap)
            if d > best * ratio * slack and len(out) >= DEGREE:
                break
            best = min(best, d)
            out.append((d, c))
            new = [n for n in self.graph[c] if n not in seen]
            if new:
                seen.update(new)
                for n, e in zip(new, np.sqrt(((self.centroids[new] - q) ** 2).sum(axis=1)), strict=True):
                    heappush(heap, (float(e), int(n)))
        return [(d, c) for d, c in sorted(out) if d <= best * ratio]


def halved(x: np.ndarray, parts: int, rng: np.random.Generator) -> list[np.ndarray]:
    """``parts`` (a power of two) groups of equal size: two means at a time, cut at the median between them."""
    todo = [x]
    while len(todo) < parts:
        out = []
        for g in todo:
            a, b = g[rng.integers(len(g))], g[rng.integers(len(g))]
            for _ in range(6):
                side = g @ (a - b)
                cut_at = np.median(side)
                if (side > cut_at).any() and (side <= cut_at).any():
                    a, b = g[side > cut_at].mean(axis=0), g[side <= cut_at].mean(axis=0)
            order = np.argsort(g @ (a - b), kind="stable")
            out += [g[order[: len(g) // 2]], g[order[len(g) // 2:]]]
        todo = out
    return todo


def homes(distance: np.ndarray, between: np.ndarray) -> list[list[int]]:
    """Lists of each vector, from its distances to centroids: the nearest, and for vectors on a boundary others about as near.

    A further list is left out when a chosen one is much nearer to it than the vector is, as it reaches the same queries.
    """
    out = []
    for row in distance:
        near = np.argsort(row, kind="stable")[: 4 * COPIES]
        chosen = [int(near[0])]
        for c in near[1:]:
            if row[c] > row[near[0]] * (1 + CLOSURE) or len(chosen) == COPIES:
                break
            if all(between[c, k] > row[c] * SPREAD for k in chosen):
                chosen.append(int(c))
        out.append(chosen)
    return out


def build(x: np.ndarray, total: int, longest: float, nearest: int = NEAREST) -> Lists:
    """Lists from sampled vectors; their number follows the square root of ``total``.

    The ratio is fitted: for sampled queries, how much further than the nearest centroid a list with one of the true
    ``nearest`` neighbours in the sample is; ``TARGET`` of them are within it.
    """
    rng = np.random.default_rng(9)
    index = Lists(np.zeros((0, 0)), np.zeros((0, 0), int), longest)
    lifted = index.lifted(x)
    parts = 1 << int(np.clip(np.log2(max(1.0, np.sqrt(total))), 0, min(np.log2(LISTS), np.log2(max(1, len(x) // 8)))))
    index.centroids = np.array([g.mean(axis=0) for g in halved(lifted, parts, rng)])
    between = np.sqrt(distances(index.centroids, index.centroids))
    index.graph = np.argsort(between, axis=1, kind="stable")[:, 1: DEGREE + 1]
    # A ring through all centroids keeps the graph in one piece.
    ring = np.roll(np.arange(parts), 1)[:, None]
    index.graph = np.hstack([index.graph, ring, np.roll(np.arange(parts), -1)[:, None]])
    some = rng.permutation(len(x))[:256]
    q = index.asked(x[some])
    score = x[some] @ x.T
    score[np.arange(len(some)), some] = -np.inf
    # The sample is thinner than the whole: only the neighbours as near as ``nearest`` would be there are asked for.
    count = int(np.clip(round(nearest * len(x) / max(total, 1)), 4, max(4, nearest)))
    best = np.argsort(-score, axis=1)[:, :count]
    of = homes(np.sqrt(distances(lifted, index.centroids)), between)
    far = np.sqrt(distances(q, index.centroids))
    need = [min(far[k, c] for c in of[b]) / far[k].min() for k in range(len(some)) for b in best[k]]
    index.ratio = max(1.0, float(np.quantile(need, TARGET)) + 1e-9) if need else 1.0
    return index


def _place(batches: Iterator[pa.RecordBatch], lists: dict[int, Lists]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        of: list[list[int]] = [[0]] * batch.num_rows
        lengths = batch.column(1).value_lengths().to_numpy()
        for n in np.unique(lengths):
            if (index := lists.get(int(n))) is not None:
                at = np.flatnonzero(lengths == n)
                between = np.sqrt(distances(index.centroids, index.centroids))
                far = np.sqrt(distances(index.lifted(matrix(batch.column(1).take(pa.array(at)))), index.centroids))
                for row, found in zip(at, homes(far, between), strict=True):
                    of[row] = found
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(of, pa.list_(pa.int32()))], [*batch.schema.names, "lists"])


def _ask(batches: Iterator[pa.RecordBatch], lists: dict[int, Lists]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        of: list[list[int]] = [[0]] * batch.num_rows
        lengths = batch.column(1).value_lengths().to_numpy()
        for row, (n, v) in enumerate(zip(lengths, batch.column(1), strict=True)):
            if (index := lists.get(int(n))) is not None:
                q = index.asked(np.array(v.as_py(), np.float64)[None])[0]
                of[row] = [c for _, c in index.walk(q, index.ratio)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(of, pa.list_(pa.int32()))], [*batch.schema.names, "lists"])


def _search(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    for t in runs(batches, ["size", "list", "i", "j"]):
        side, ids, x = t.column("side").to_numpy(), t.column("id").to_numpy(), matrix(t.column("v"))
        held, asked = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        score = x[asked] @ x[held].T
        out = []
        for k, row in enumerate(score):
            # All that tie with the last one stay, so that the order of ids can decide later.
            last = np.partition(row, -most)[-most] - 1e-9 if len(row) > most else -np.inf
            near = held[row >= last]
            out.append((np.full(len(near), ids[asked[k]]), ids[near], (x[near] * x[asked[k]]).sum(axis=1)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["query_id", "rep", "score"])


def nearest(vectors: DataFrame, asked: DataFrame, most: int = NEAREST) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row of ``asked`` the ``most`` nearest found in ``vectors`` (both vec_id, embedding).

    Nearest are the largest inner products in double precision, ties by smaller vec_id; a row is no neighbour of the same
    vec_id. A bounded sample gives posting lists of equal size; vectors near a boundary are held by several lists.
    A query finds its nearest centroids on a graph and reads the lists within a ratio of the nearest distance,
    fitted on the sample. Equal vectors are held once, with their ``most + 1`` smallest ids, more than any query needs. Lists
    are read in blocks, so one that holds much of the data is many tasks; each task passes its best on.

    Vectors that are null, zero, or hold null or non-finite components, or have a null vec_id, take no part; so do
    candidates of another length than the query. Repeated rows of a vec_id count once. Other columns are ignored; an empty table gives an empty result.
    """
    rows, queries = (df.select("vec_id", F.col("embedding").alias("v")).where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).distinct() for df in (vectors, asked))
    rows, _ = cut(rows.withColumn("print", F.xxhash64("v")), "vectors")
    kind = rows.schema["v"].dataType.simpleString()
    classes, total = cut(rows.groupBy("print", "v").agg(F.min("vec_id").alias("id")), "classes")
    least = top_n(rows.join(classes, ["print", "v"]).select("id", "vec_id"), ["id"], [F.col("vec_id")], most + 1, ["vec_id"]).drop("rank")
    members, _ = cut(least.groupBy("id").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "members")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    longest = {r[0]: r[1] for r in classes.groupBy(F.size("v")).agg(F.max(norm)).toLocalIterator()}
    lists = {n: build(x, total, longest[n], most) for n, x in sample(classes, "v", SAMPLE, total).items()}
    schema = f"id long, v {kind}, size int, lists array<int>"
    held = classes.select("id", "v", F.size("v").alias("size")).mapInArrow(partial(_place, lists=lists), schema)
    asks = queries.select(F.col("vec_id").alias("id"), F.col("v").cast(kind).alias("v"), F.size("v").alias("size")).mapInArrow(partial(_ask, lists=lists), schema)
    held, asks = (cut(df.select("size", F.explode("lists").alias("list"), "id", "v"), "postings")[0] for df in (held, asks))
    found = blocked(held, asks, ["size", "list"], "id").mapInArrow(partial(_search, most=most + 1), "query_id long, rep long, score double")
    # A vector held by several lists is found as often.
    found = found.groupBy("query_id", "rep").agg(F.max("score").alias("score"))
    found = found.withColumn("n", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "rep"))).where(F.col("n") <= most + 1)
    each = found.join(members, F.col("rep") == F.col("id")).select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id != query_id")
    ranked = each.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= most).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
