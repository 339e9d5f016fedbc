"""Line dedup by pairwise alignment: blocks of lines that an earlier document has go from the later one."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import SPACE, listed, lists, longs, mix, span_hashes, texts
from corpuslens.session import cut

LEAST_WORDS = 30  # of a common block that is deleted
_STEP = np.uint64(0x9E3779B97F4A7C15)


def line_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash and the number of words of each line of one text; lines end at ``\\n``."""
    ends = np.append(np.flatnonzero(data == 10), len(data))
    starts = np.append(0, ends[:-1] + 1)
    inside = ~SPACE[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    sums = np.append(0, np.cumsum(begin))
    words = sums[ends] - sums[starts]
    return span_hashes(data, starts, ends, exact=True), words


def anchors(lines: np.ndarray, words: np.ndarray, least: int) -> np.ndarray:
    """Hash of the shortest run of filled lines from each line on that has ``least`` words; runs that end early have none."""
    full = np.flatnonzero(words)
    lines, sums = lines[full], np.append(0, np.cumsum(words[full]))
    last = np.searchsorted(sums, sums[:-1] + least)  # lines [i, last) have enough words
    n = int((last <= len(lines)).sum())
    run = np.zeros(n, np.uint64)
    for k in range(int((last[:n] - np.arange(n)).max(initial=0))):
        more = np.flatnonzero(np.arange(n) + k < last[:n])
        run[more] = mix(run[more] * _STEP + lines[more + k])
    return run


def _scan(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for at, data, offsets in texts(batch):
            docs = [line_hashes(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            runs = [np.unique(anchors(*d, least)) for d in docs]
            bounds = [np.concatenate([[0], np.cumsum([len(x) for x in xs])]) for xs in ([d[0] for d in docs], runs)]
            yield pa.RecordBatch.from_arrays(
                [ids.slice(at, len(docs)), lists(longs(np.concatenate([d[0] for d in docs])), bounds[0]),
                 lists(np.concatenate([d[1] for d in docs]).astype(np.int32), bounds[0]), lists(longs(np.concatenate(runs)), bounds[1])],
                ["doc_id", "lines", "words", "anchors"])


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence of (i, j), sorted by i, that rises in j."""
    tails: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for k, (_, j) in enumerate(pairs):
        p = bisect_left(tails, j)
        back.append(at[p - 1] if p else -1)
        if p == len(tails):
            tails.append(j)
            at.append(k)
        else:
            tails[p], at[p] = j, k
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def aligned(x: Sequence[int], y: Sequence[int]) -> list[tuple[int, int]]:
    """Patience alignment of two line lists: pairs (i, j) of equal lines that rise in both.

    Lines that both lists have once are matched along their longest rising run; equal lines next to a match
    extend it; what lies between two matches is aligned the same way. Where no line is
    unique on both sides, equal lines are matched from the start on.
    """
    out, todo = [], [(0, len(x), 0, len(y))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and x[a] == y[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and x[b - 1] == y[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a >= b or c >= d:
            continue
        places: dict[int, int] = {}
        for j in range(c, d):
            places[y[j]] = -1 if y[j] in places else j
        seen: dict[int, int] = {}
        for i in range(a, b):
            seen[x[i]] = -1 if x[i] in seen else i
        fixed = _rising([(i, places[v]) for v, i in sorted(seen.items(), key=lambda e: e[1]) if i >= 0 and places.get(v, -1) >= 0])
        if not fixed:
            j = c
            spots: dict[int, list[int]] = {}
            for k in range(c, d):
                spots.setdefault(y[k], []).append(k)
            for i in range(a, b):
                if (ks := spots.get(x[i])) and (p := bisect_left(ks, j)) < len(ks):
                    out.append((i, ks[p]))
                    j = ks[p] + 1
            continue
        out += fixed
        edges = [(a - 1, c - 1), *fixed, (b, d)]
        todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges[:-1], edges[1:], strict=True)]
    return sorted(out)


def shared_runs(early: Sequence[int], late: Sequence[int], words: Sequence[int], least: int) -> set[int]:
    """Places in ``late`` of all runs of lines with ``least`` words or more that ``early`` has too, in whatever order; all lines are filled.

    The shortest such runs from each line on, and up to each line, cover the longer ones.
    """
    count = dict(zip(late, words, strict=True))  # a run with a line that only ``early`` has is not shared
    out: set[int] = set()
    for way in (1, -1):
        x, y = (np.array(v[::way], np.int64).view(np.uint64) for v in (early, late))
        n = np.array(words[::way], np.int64)
        ours = anchors(y, n, least)
        sums = np.append(0, np.cumsum(n))
        last = np.searchsorted(sums, sums[:-1] + least)
        for i in np.flatnonzero(np.isin(ours, anchors(x, np.array([count.get(v, 1) for v in early[::way]], np.int64), least))).tolist():
            out.update(range(i, int(last[i])) if way > 0 else range(len(late) - int(last[i]), len(late) - i))
    return out


def common_blocks(early: Sequence[int], late: Sequence[int], words: Sequence[int], least: int) -> set[int]:
    """Lines of ``late`` in blocks of aligned neighbours with ``least`` words or more; all lines are filled.

    Aligned anew without the deleted lines. When an alignment has no such block, what is left of ``shared_runs`` goes, and so on
    until no common run is left: moved, crossed, overlapping and repeated blocks are found too.
    """
    gone: set[int] = set()
    left = list(range(len(late)))
    while left:
        pairs = aligned(early, [late[i] for i in left])
        went: set[int] = set()
        block: list[int] = []
        for n, (i, j) in enumerate(pairs):
            if n and (i, j) != (pairs[n - 1][0] + 1, pairs[n - 1][1] + 1):
                block = []
            block.append(left[j])
            if sum(words[k] for k in block) >= least:
                went.update(block)
        if not went:
            went = shared_runs(early, late, words, least) - gone
        if not went and gone:
            went = {left[j] for j in shared_runs(early, [late[i] for i in left], [words[i] for i in left], least)}
        if not went:
            return gone
        gone |= went
        left = [i for i in left if i not in went]
    return gone


def _align(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        late_of, lines = [], []
        for doc, early, ew, late, lw in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
            full = [i for i, n in enumerate(lw) if n]
            gone = common_blocks([v for v, n in zip(early, ew, strict=True) if n], [late[i] for i in full], [lw[i] for i in full], least)
            late_of.append(doc)
            lines.append(sorted(full[i] for i in gone))
        yield pa.RecordBatch.from_arrays([pa.array(late_of, pa.int64()), pa.array(lines, pa.list_(pa.int32()))], ["doc_id", "gone"])


def dedup_lines(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """``docs`` (doc_id, text and any others) with ``text`` cut, and ``n_lines``, ``deleted_lines`` (their numbers, from 0).

    Documents overlap when they share a run of lines of ``least`` words; each such run, and so every block that could
    be deleted, ties a document to the first (smallest doc_id) that has it. The two are aligned by
    patience diff over line hashes, and aligned blocks of ``least`` words or more leave the later one with their line
    ends, as do common runs of so many words that the alignment crosses, until none is left. Common lines alone make no pair, so boilerplate shorter than a block stays. Pairs grow with the number of lines, not with its
    square; only hashes move until the deletions are applied.

    Null text stays null with 0 lines; empty text has one empty line. Rows with equal doc_id are one document and are
    cut alike; a null doc_id is neither cut nor compared. Blank lines belong to no block and stay. A column named
    n_lines or deleted_lines is replaced. An empty table gives an empty result.
    """
    docs = docs.drop("n_lines", "deleted_lines")
    one = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    scanned, _ = cut(one.mapInArrow(partial(_scan, least=least), "doc_id long, lines array<long>, words array<int>, anchors array<long>"), "lines")
    runs = scanned.select("doc_id", F.explode("anchors").alias("h"))
    first = runs.groupBy("h").agg(F.min("doc_id").alias("early"), F.max("doc_id").alias("last")).where("early < last").select("h", "early")
    pairs, _ = cut(runs.join(first, "h").where("early < doc_id").select("doc_id", "early").distinct(), "overlaps")
    late = scanned.select("doc_id", "lines", "words").dropDuplicates(["doc_id"])
    early = late.select(F.col("doc_id").alias("early"), F.col("lines").alias("early_lines"), F.col("words").alias("early_words"))
    both = pairs.join(early, "early").join(late, "doc_id").select("doc_id", "early_lines", "early_words", "lines", "words")
    found = both.mapInArrow(partial(_align, least=least), "doc_id long, gone array<int>").where(F.size("gone") > 0)
    # At most one array per early document, which a document has no more of than lines.
    gone = found.groupBy("doc_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("deleted_lines"))
    gone = listed(gone, "deletions", F.sum(1 + F.size("deleted_lines")))
    lines = F.split("text", "\n", -1)
    kept = F.filter(lines, lambda _, i: ~F.array_contains("deleted_lines", i))
    out = docs.join(gone, "doc_id", "left").withColumn("deleted_lines", F.coalesce("deleted_lines", F.array().cast("array<int>")))
    return out.withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(F.size(lines))).withColumn(
        "text", F.when(F.size("deleted_lines") > 0, F.array_join(kept, "\n")).otherwise(F.col("text")))
