"""Embedding near-duplicates over an inverted multi-index: codebooks on vector halves, cells in order of distance."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import components, runs
from corpuslens.llm.vectors import blocked, matrix, sample, usable
from corpuslens.session import cut

SIMILAR = 0.93
SAMPLE = 16_384  # vectors that codebooks are fitted on, at most
ROWS = 8192  # vectors of a label per cell that the size of the codebooks aims at, and rows of a side that a task compares
WORDS = 256  # words of a codebook, at most
FEWEST = 4  # and at least
PRODUCTS = 1 << 21  # products that are held at a time

Books = dict[int, tuple[np.ndarray, np.ndarray]]


def codebook(x: np.ndarray, words: int, rounds: int = 12) -> np.ndarray:
    """Centres by k-means from a fixed start."""
    x = np.unique(x, axis=0)
    centres = x[np.random.default_rng(3).permutation(len(x))[:words]]
    for _ in range(rounds):
        near = distances(x, centres).argmin(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        count = np.bincount(near, minlength=len(centres))
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
    return np.unique(centres, axis=0)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows."""
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * x @ y.T, 0)


def bounds(x: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest word of each row, and squared distances that points of each word's region have from the row at least.

    A region ends halfway between two words, so the distance to that border bounds it from below.
    """
    far = distances(x, words)
    apart = np.sqrt(distances(words, words)) + np.eye(len(words))
    low = np.zeros_like(far)
    for k in range(len(words)):
        low = np.maximum(low, (far - far[:, k, None]) / (2 * apart[k]))
    return far.argmin(axis=1), low**2


def radius(least: float) -> float:
    """Squared distance of a cell from a vector up to which cells are visited: that of two unit vectors at the least similarity, which no neighbour exceeds."""
    return 2 - 2 * least + 1e-4  # what sums of single precision may be off


def traverse(one: np.ndarray, two: np.ndarray, radius: float) -> list[tuple[int, int]]:
    """Cells (i, j) in order of ``one[i] + two[j]`` up to ``radius``, by the multi-sequence walk over both sorted lists."""
    a, b = np.argsort(one, kind="stable"), np.argsort(two, kind="stable")
    heap, seen, out = [(one[a[0]] + two[b[0]], 0, 0)], {(0, 0)}, []
    while heap:
        low, i, j = heappop(heap)
        if low > radius:
            break
        out.append((int(a[i]), int(b[j])))
        for i, j in ((i + 1, j), (i, j + 1)):
            if i < len(a) and j < len(b) and (i, j) not in seen:
                seen.add((i, j))
                heappush(heap, (one[a[i]] + two[b[j]], i, j))
    return out


def _cells(batches: Iterator[pa.RecordBatch], books: Books, least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own: list[int] = [0] * batch.num_rows
        visits: list[list[int]] = [[0]] * batch.num_rows
        vectors = batch.column(2)
        lengths = vectors.value_lengths().to_numpy()
        for n in np.unique(lengths):
            at = np.flatnonzero(lengths == n)
            if int(n) not in books:
                continue
            x = matrix(vectors.take(pa.array(at)))
            x /= np.linalg.norm(x, axis=1)[:, None]
            one, two = books[int(n)]
            reach = radius(least)
            (i, low1), (j, low2) = bounds(x[:, : n // 2], one), bounds(x[:, n // 2:], two)
            for k, row in enumerate(at):
                own[row] = int(i[k]) * len(two) + int(j[k])
                cells = (a * len(two) + b for a, b in traverse(low1[k], low2[k], reach))
                # The other way round finds the pair too, as the radius leaves no neighbour out, so one of the two is enough.
                visits[row] = sorted({own[row], *(c for c in cells if c > own[row])})
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int32()), pa.array(visits, pa.list_(pa.int32()))], [*batch.schema.names, "own", "visits"])


def _pairs(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for t in runs(batches, ["label", "size", "cell", "i", "j"]):
        side, own = t.column("side").to_numpy(), t.column("own").to_numpy()
        cell = t.column("cell")[0].as_py()
        ids, x = t.column("rep").to_numpy(), matrix(t.column("v"))
        x /= np.linalg.norm(x, axis=1)[:, None]
        held, asked = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        some = max(1, PRODUCTS // max(1, len(held)))
        for at in range(0, len(asked), some):
            part = asked[at: at + some]
            a, b = np.nonzero(x[part] @ x[held].T >= least - 1e-9)
            a, b = part[a], held[b]
            first = (own[a] != cell) | (ids[a] < ids[b])
            a, b = a[first], b[first]
            for k in range(0, len(a), some):
                # Borderline products are decided by one sum per pair.
                c, d = a[k: k + some], b[k: k + some]
                keep = (x[c] * x[d]).sum(axis=1) >= least
                c, d = ids[c[keep]], ids[d[keep]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(c, d), pa.int64()), pa.array(np.maximum(c, d), pa.int64())], ["a", "b"])


def near_duplicates(vectors: DataFrame, least: float = SIMILAR) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of ``vectors`` (vec_id, embedding, label).

    Two vectors are linked when their labels are equal and their cosine is ``least`` or more. Equal vectors of a label
    are one class, counted but not compared. Each half of the unit vectors has its own codebook, fitted on a
    bounded sample; the grid of both is the index. From each class the cells are visited in order of the least
    distance that a point in them can have, as far as a linked vector can be (``radius``), so no link is missed; each pair met is then
    verified. Cells are compared in blocks, so a large one is many tasks. A visit carries its vector, and where vectors have
    little contrast most cells are visited; so cells are as large as a task compares at once, and visits of a vector one for ``ROWS``
    vectors of its label, ``FEWEST ** 2`` at least.

    Vectors that are null, zero, or hold null or non-finite components, and those with a null label, are linked with nothing
    and are their own component. Vectors of different length are never linked. Rows with equal vec_id are linked as any two rows and
    get a row each; a null vec_id is not linked and has null component_id and kept. Other columns are ignored; an empty
    table gives an empty result.
    """
    rows = vectors.select("vec_id", F.col("embedding").alias("v"), F.col("label").cast("long").alias("label"))
    rows = rows.withColumn("fit", usable(F.col("v")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    rows, _ = cut(rows.withColumn("print", F.xxhash64("v")), "vectors")
    key = ["label", "print", "v"]
    classes, total = cut(rows.where("fit").groupBy(*key).agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("many")), "classes")
    most = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    words = int(np.clip(np.sqrt(most / ROWS), FEWEST, WORDS))
    books: Books = {}
    for n, x in sample(classes, "v", SAMPLE, total).items():
        x = x / np.linalg.norm(x, axis=1)[:, None]
        books[n] = (codebook(x[:, : n // 2], words), codebook(x[:, n // 2:], words)) if n > 1 else (np.zeros((1, 0)), np.zeros((1, 1)))
    kind = classes.schema["v"].dataType.simpleString()
    placed = classes.select("rep", "label", "v", F.size("v").alias("size")).mapInArrow(
        partial(_cells, books=books, least=least), f"rep long, label long, v {kind}, size int, own int, visits array<int>")
    placed, _ = cut(placed, "placed")
    held = placed.select("label", "size", F.col("own").alias("cell"), "rep", "own", "v")
    asked = placed.select("label", "size", F.explode("visits").alias("cell"), "rep", "own", "v")
    pairs = blocked(held, asked, ["label", "size", "cell"], "rep", ROWS).mapInArrow(partial(_pairs, least=least), "a long, b long")
    pairs, _ = cut(pairs, "links")
    many = classes.select("rep", "many")
    ends = pairs.union(pairs.select("b", "a")).toDF("rep", "other")
    others = ends.join(many.toDF("other", "others"), "other").groupBy("rep").agg(F.sum("others").alias("others"))
    of = classes.select(*key, "rep", "many").join(others, "rep", "left").join(components(pairs).withColumnRenamed("node", "rep"), "rep", "left")
    of = of.select("print", "rep", F.col("label").alias("l"), F.col("v").alias("w"), (F.col("many") - 1 + F.coalesce("others", F.lit(0))).alias("n"), F.coalesce("component", "rep").alias("top"))
    out = rows.join(of, (rows["print"] == of["print"]) & (rows["label"] == of["l"]) & (rows["v"] == of["w"]) & rows["fit"], "left")
    top = F.coalesce("top", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), top.alias("component_id"), (F.col("vec_id") == top).alias("kept"))
