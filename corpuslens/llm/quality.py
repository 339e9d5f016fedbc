"""Quality scores: ridge over random Fourier features of document statistics, calibrated by isotonic regression."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import texts, word_spans, span_hashes
from corpuslens.session import cut

WAVES = 384  # random Fourier features
RIDGE = 1e-3
PARTS = 32  # partitions that sum normal equations
SAMPLE = 200_000  # labelled documents that are learned from at most
ACCEPT = 0.7

_KINDS = np.zeros((256, 8), np.float64)  # upper, lower, digit, line end, sentence mark, other mark, beyond ASCII, white space
for _c in range(256):
    _s = chr(_c)
    _KINDS[_c, 6 if _c > 127 else 0 if _s.isupper() else 1 if _s.islower() else 2 if _s.isdigit() else 3 if _s == "\n" else 7 if _s.isspace() else 4 if _s in ".,;:?" else 5] = 1


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of statistics per text: shares of kinds of bytes and words, repetition, lengths."""
    n, sizes = len(offsets) - 1, np.diff(offsets)
    out = np.zeros((n, 8 + 12))
    code = _KINDS.argmax(axis=1)[data] if len(data) else np.zeros(0, int)
    text = np.repeat(np.arange(n), sizes)
    counts = np.bincount(text * 8 + code, minlength=8 * n).reshape(n, 8)
    out[:, :8] = counts / np.maximum(sizes, 1)[:, None]
    starts, ends = word_spans(data, offsets)
    if not len(starts):
        return out
    hashes = span_hashes(data, starts, ends, exact=True) if len(data) < 1 << 24 else None
    if hashes is None:  # one very long text: the hash of each word from its pieces
        hashes = np.concatenate([span_hashes(data[a:b], starts[s:e] - a, ends[s:e] - a, exact=True) for a, b, s, e in _slices(starts, ends)])
    bounds = np.searchsorted(starts, offsets)
    words = np.diff(bounds)
    many = np.maximum(words, 1)
    of = text[starts]
    share = lambda mask: np.bincount(of, mask, n) / many
    last = code[ends - 1]
    same = np.append(hashes[1:] == hashes[:-1], False) & (np.append(of[1:], -1) == of)
    length = ends - starts
    out[:, 8] = np.log1p(words)
    out[:, 9] = np.bincount(of, np.log(length), n) / many
    out[:, 10] = share(same)
    out[:, 11] = share(last == 5)
    out[:, 12] = share(length == 1)
    out[:, 13] = share((code[starts] == 0) & (code[ends - 1] == 0) & (length > 1))
    out[:, 14] = share((last == 4))
    out[:, 15] = np.log1p(counts[:, 3])
    out[:, 16] = np.log1p(words / (counts[:, 3] + 1))
    out[:, 19] = share(code[starts] == 0)
    for i in np.flatnonzero(words):
        _, c = np.unique(hashes[bounds[i]: bounds[i + 1]], return_counts=True)
        out[i, 17] = len(c) / words[i]
        out[i, 18] = c.max() / words[i]
    return out


def _slices(starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    s = 0
    while s < len(starts):
        e = max(s + 1, int(np.searchsorted(ends, starts[s] + (1 << 22), "right")))
        yield int(starts[s]), int(ends[e - 1]), s, e
        s = e


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, data, offsets in texts(batch):
            n = len(offsets) - 1
            rows = statistics(data, offsets)
            values = pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), rows.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(at, n) for i in range(batch.num_columns - 1)), values], [*batch.schema.names[:-1], "x"])


@dataclass
class Model:
    """Statistics are scaled, turned into waves, weighed, and the sum mapped through steps that rise."""

    mean: np.ndarray
    scale: np.ndarray
    waves: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    at: np.ndarray
    level: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([np.sqrt(2 / len(self.phase)) * np.cos(z @ self.waves + self.phase), np.ones((len(x), 1))])

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(x), 0.5)
        raw = self.features(x) @ self.weights
        return np.clip(np.interp(raw, self.at, self.level) if len(self.at) else raw, 0, 1)


def rising(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression by pooling neighbours: (raw score, calibrated score) of each pool."""
    order = np.argsort(raw, kind="stable")
    pools: list[list[float]] = []
    for r, v in zip(raw[order], y[order], strict=True):
        pools.append([v, 1.0, r])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            v2, n2, r2 = pools.pop()
            v1, n1, r1 = pools.pop()
            pools.append([(v1 * n1 + v2 * n2) / (n1 + n2), n1 + n2, (r1 * n1 + r2 * n2) / (n1 + n2)])
    # A pool counts a doubtful row each way, so that few rows never make a sure score.
    return np.array([p[2] for p in pools]), np.maximum.accumulate(np.array([(p[0] * p[1] + 0.5 * 0.02) / (p[1] + 0.02) for p in pools]))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def fit(rows: DataFrame, sample: int = SAMPLE, seed: int = 11) -> Model:
    """A model from ``rows`` (doc_id, x, quality). Of more than ``sample`` rows those with the least hash are learned from.

    Each of ``PARTS`` partitions sums its part of the normal equations, one for each of two halves of the rows; each half is scored by
    the weights of the other, and those scores calibrate. No more than ``PARTS`` sums and ``sample`` scores reach the driver.
    """
    hashed = F.xxhash64("doc_id", F.lit(seed))
    count = rows.count()
    if count > sample:
        rows = rows.where(F.pmod(hashed, F.lit(1 << 30)) < int((1 << 30) * (sample / count)))
    rows, count = cut(rows.select("x", "quality", (F.pmod(hashed, F.lit(2)) == 1).alias("half"), F.pmod(hashed, F.lit(PARTS)).alias("part")).repartition(PARTS, "part"), "labelled")
    if not count:
        return Model(*[np.zeros(0)] * 7)
    width = rows.select(F.size("x")).first()[0]
    sums = rows.select(*(f(F.get("x", F.lit(i))).alias(f"{f.__name__}{i}") for i in range(width) for f in (F.avg, F.stddev_pop))).first()
    rng = np.random.default_rng(seed)
    spread = np.array(sums[1::2])
    model = Model(np.array(sums[0::2]), np.where(spread > 1e-9, spread, 1.0), rng.normal(size=(width, WAVES)) / np.sqrt(width), rng.uniform(0, 2 * np.pi, WAVES), np.zeros(WAVES + 1), np.zeros(0), np.zeros(0))

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, WAVES + 1, WAVES + 2))
        for b in batches:
            if b.num_rows:
                f, y, half = model.features(_matrix(b.column(0))), b.column(1).to_numpy(), b.column(2).to_numpy(zero_copy_only=False)
                for h in (0, 1):
                    m = half == bool(h)
                    total[h] += f[m].T @ np.hstack([f[m], y[m, None]])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["total"])

    total = sum(np.frombuffer(bytes(r[0])).reshape(2, WAVES + 1, WAVES + 2) for r in rows.coalesce(PARTS).mapInArrow(equations, "total binary").toLocalIterator())
    solve = lambda t: np.linalg.solve(t[:, :-1] + RIDGE * max(1.0, t[-1, -2]) / 100 * np.eye(len(t)), t[:, -1])
    halves = [solve(total[1]), solve(total[0])]

    def crossed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                f = model.features(_matrix(b.column(0)))
                yield pa.RecordBatch.from_arrays([pa.array(np.where(b.column(2).to_numpy(zero_copy_only=False), f @ halves[1], f @ halves[0])), b.column(1).cast(pa.int32())], ["raw", "y"])

    got = rows.mapInArrow(crossed, "raw double, y int").toPandas().sort_values(["raw", "y"])
    model.weights = solve(total[0] + total[1])
    model.at, model.level = rising(got["raw"].to_numpy(), got["y"].to_numpy(float))
    return model


def score(docs: DataFrame, labels: DataFrame, learn: object = None, accept: float = ACCEPT) -> DataFrame:
    """doc_id, score (0 to 1, higher: quality 1 likelier), predicted (1 from ``accept`` on) for each row of ``docs`` (doc_id, text).

    ``labels`` (doc_id, quality) mark some documents; ``learn`` is a condition on doc_id that learned rows meet. Scores are made
    from statistics of whole texts alone. Null text counts as empty and has a score as any other. Labels that are null, or that
    differ for one doc_id, are not learned from; without any usable label all scores are 0.5. Rows with a null or
    repeated doc_id are all scored. Other columns are ignored; an empty table gives an empty result.
    """
    measured, _ = cut(docs.select("doc_id", "text").mapInArrow(_measure, "doc_id long, x array<double>"), "statistics")
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("q")).where("quality = q").drop("q")
    if learn is not None:
        known = known.where(learn)
    model = fit(measured.dropDuplicates(["doc_id"]).join(known, "doc_id"))

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores(_matrix(b.column(1))) if b.num_rows else [], pa.float64())], ["doc_id", "score"])

    return measured.mapInArrow(scores, "doc_id long, score double").withColumn("predicted", (F.col("score") >= accept).cast("int"))
