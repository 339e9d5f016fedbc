"""MinHash near-duplicates by tensored banding, confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import LISTED, components, listed, lists, longs, mix, runs, texts, words_of
from corpuslens.session import cut

WORDS = 5  # words of a shingle
SIMILAR = 75  # least 100 * intersection / union
SIDE = 16  # sub-tables of each of the two collections
DEPTH = 3  # minhashes of a sub-table's key
TRIES = 4  # most alike classes of larger components that a class of a bucket is compared with in a round
MORE = 64  # tries of the first round over all buckets, and by what they grow from round to round
FIRST = 8  # of so many buckets one is used in the round that tries most alike classes of any component
LEAST = 48  # minhashes, of the 96, that agree: at the least similarity 72 do on average, with a deviation of about 4
BITS = 1024  # parities of a sketch: each of the number of shingles whose hashes fall there
BLOCK = 4_096  # classes of a bucket that a task compares at a time, with as many others; each class is sent once for every block of its bucket
HELD = 1 << 18  # pairs to try that a task holds before it tells each of them once

_rng = np.random.default_rng(77)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SHORT = np.uint64(0xC2B2AE3D27D4EB4F)
_ODD = np.uint64(0xA0761D6478BD642F)
_MULT = _rng.integers(1, 1 << 63, 2 * SIDE * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(words: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """The distinct shingles of each text, sorted; a text of fewer words is one shingle."""
    if len(words) >= WORDS:
        run = words[: len(words) - WORDS + 1].copy()
        for k in range(1, WORDS):
            run = run * _STEP + words[k: len(words) - WORDS + 1 + k]
        run = mix(run)
    out = []
    for at, end in zip(bounds[:-1], bounds[1:], strict=True):
        if end - at >= WORDS:
            out.append(np.unique(run[at: end - WORDS + 1]))
        elif end > at:
            h = np.array([end - at], np.uint64) * _SHORT
            for w in words[at:end]:
                h = h * _STEP + w
            out.append(mix(h))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def sub_keys(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """``2 * SIDE`` keys of ``DEPTH`` minhashes each for non-empty sets, and a byte of each minhash."""
    every = np.concatenate(sets)
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    keys = np.zeros((len(sets), 2 * SIDE), np.uint64)
    marks = np.zeros((len(sets), len(_MULT)), np.uint8)
    for j in range(2 * SIDE):
        for k in range(DEPTH):
            low = np.minimum.reduceat((every * _MULT[j * DEPTH + k]) >> np.uint64(16), at)
            marks[:, j * DEPTH + k] = low & np.uint64(0xFF)
            keys[:, j] = mix(keys[:, j] * _STEP + low + np.uint64(j + 1))
    return keys, marks


def parities(sets: list[np.ndarray]) -> np.ndarray:
    """A row of ``BITS`` bits for each set: whether an odd number of its shingles falls on a bit.

    Shingles of both sets cancel out, so bits in which two rows differ are never more than the shingles that only one set has."""
    of = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    at = (mix(np.concatenate(sets) * _ODD) & np.uint64(BITS - 1)).astype(np.int64)
    return np.packbits((np.bincount(of * BITS + at, minlength=len(sets) * BITS) & 1).astype(bool).reshape(-1, BITS), axis=1)


def unlike(x: np.ndarray, y: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether parities ``x`` and ``y`` alone show that sets of ``sizes`` shingles together are less than ``SIMILAR``."""
    differ = np.bitwise_count(x.view(np.uint64) ^ y.view(np.uint64)).sum(axis=-1, dtype=np.int64)
    return (100 + SIMILAR) * differ > (100 - SIMILAR) * sizes


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for at, data, offsets in texts(batch):
            sets = shingles(*words_of(data, offsets))
            n = np.array([len(s) for s in sets])
            full = [s for s in sets if len(s)]
            keys, bytes_of = sub_keys(full) if full else (np.zeros((0, 2 * SIDE), np.uint64), np.zeros((0, len(_MULT)), np.uint8))
            marks: list[bytes | None] = [None] * len(sets)
            for i, row, bits in zip(np.flatnonzero(n), bytes_of, parities(full) if full else bytes_of, strict=True):
                marks[i] = row.tobytes() + bits.tobytes()
            every = np.concatenate([*full, np.zeros(0, np.uint64)])
            starts = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
            prints = [np.zeros(len(sets), np.uint64) for _ in range(2)]
            for p, salt in zip(prints, (_STEP, _SHORT), strict=True):
                sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(every * salt), dtype=np.uint64)])
                p += sums[starts[1:]] - sums[starts[:-1]]
            bounds = np.concatenate([[0], np.cumsum((n > 0) * 2 * SIDE)])
            yield pa.RecordBatch.from_arrays(
                [ids.slice(at, len(n)), pa.array(n, pa.int64()), pa.array(longs(prints[0])), pa.array(longs(prints[1])), lists(longs(keys.ravel()), bounds), pa.array(marks, pa.binary())],
                ["doc_id", "n_shingles", "p0", "p1", "keys", "mark"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for at, data, offsets in texts(batch):
            sets = shingles(*words_of(data, offsets))
            yield pa.RecordBatch.from_arrays([ids.slice(at, len(sets)), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "items"])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = np.zeros(batch.num_rows, bool)
        for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
            x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            less, more = sorted((x, y), key=len)
            if 100 * len(less) < SIMILAR * len(more):
                continue
            pos = np.minimum(np.searchsorted(more, less), len(more) - 1)
            both = int((more[pos] == less).sum())
            keep[i] = 100 * both >= SIMILAR * (len(x) + len(y) - both)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))


def _parted(marks: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of minhashes, and parities."""
    both = np.frombuffer(b"".join(marks.to_pylist()), np.uint8).reshape(-1, len(_MULT) + BITS // 8)
    return both[:, : len(_MULT)], np.ascontiguousarray(both[:, len(_MULT):])


def _plausible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = (_parted(batch.column(c))[0] for c in (2, 3))
        yield batch.select([0, 1]).filter(pa.array((x == y).sum(axis=1) >= LEAST))


def plausible(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """The pairs (a, b) whose ``marks`` (doc_id, mark) agree often enough."""
    x, y = (marks.select(F.col("doc_id").alias(c), F.col("mark").alias(f"{c}_mark")) for c in "ab")
    return pairs.join(x, "a").join(y, "b").select("a", "b", "a_mark", "b_mark").mapInArrow(_plausible, "a long, b long")


def confirmed(docs: DataFrame, pairs: DataFrame) -> tuple[DataFrame, int, DataFrame, int]:
    """The pairs (a, b) whose full sets are similar enough, and their number; all pairs, and theirs. Only texts of documents in a pair move."""
    near, many = cut(pairs, "plausible")
    if not many:
        return near, 0, near, 0
    near = F.broadcast(near) if many <= LISTED else near
    ids = listed(near.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ids")
    sets = docs.select("doc_id", "text").join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    sets, _ = cut(sets.mapInArrow(_sets, "id long, items binary"), "sets")
    x, y = (sets.select(F.col("id").alias(c), F.col("items").alias(f"{c}_items")) for c in "ab")
    both = near.join(x, "a").join(y, "b").select("a", "b", "a_items", "b_items")
    return *cut(both.mapInArrow(_confirm, "a long, b long"), "linked"), near, many


def _within(batches: Iterator[pa.RecordBatch], tries: int, every: bool) -> Iterator[pa.RecordBatch]:
    """In each run of rows of one (key, i, j), that is two blocks of a bucket or one: the pairs to try, of different components.

    Each class tries its most alike ones of larger components: the best ``tries``, or with ``every`` as many of each component.
    Those that their parities show to be less than ``SIMILAR`` are none to try. A pair that many buckets hold is told once for many of them."""

    def pairs(t: pa.Table) -> Iterator[np.ndarray]:
        """For each class rows of both ids and 0; then of each class that is in a pair not told, twice its id and 1."""
        block, doc, size, top = (t.column(c).to_numpy() for c in ("block", "doc_id", "n", "component"))
        mark, bits = _parted(t.column("mark"))
        alone = t.column("i")[0].as_py() == t.column("j")[0].as_py()
        _, of, count = np.unique(top, return_inverse=True, return_counts=True)
        weight = count[of] * len(count) + of  # orders components by their size here
        left = np.zeros(len(doc), bool)
        for k in range(len(doc)):
            o = np.flatnonzero((weight > weight[k]) & (alone | (block != block[k])))
            o = o[100 * np.minimum(size[o], size[k]) >= SIMILAR * np.maximum(size[o], size[k])]
            o = o[~unlike(bits[o], bits[k], size[o] + size[k])]
            if len(o):
                agree = (mark[o] == mark[k]).sum(axis=1)
                o, agree = o[agree >= LEAST], agree[agree >= LEAST]
                o = o[np.lexsort((-agree, weight[o]) if every else (-agree,))]
                # With ``every``, places in the run of a component.
                now = (np.arange(len(o)) - np.searchsorted(weight[o], weight[o]) if every else np.arange(len(o))) < tries
                p = o[now]
                left[o[~now]] = True
                left[k] |= len(p) < len(o)
                yield np.stack([np.minimum(doc[p], doc[k]), np.maximum(doc[p], doc[k]), np.zeros(len(p), np.int64)], axis=1)
        yield np.stack([doc[left], doc[left], np.ones(left.sum(), np.int64)], axis=1)

    def told(held: list[np.ndarray]) -> pa.RecordBatch:
        once = np.unique(np.concatenate(held), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in once.T], ["a", "b", "more"])

    held, many = [np.zeros((0, 3), np.int64)], 0
    for t in runs(batches, ["key", "i", "j"]):
        for found in pairs(t):
            held.append(found)
            many += len(found)
            if many > HELD:
                yield told(held)
                held, many = held[:1], 0
    yield told(held)


def _labelled(rows: DataFrame, member: DataFrame) -> tuple[DataFrame, int]:
    """``rows`` of buckets that more than one component reaches, with the component of each, one bucket of those with the same members; most members."""
    rows = rows.join(member.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    whole = rows.groupBy("key").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("members"),
        F.sum(F.shiftright(F.xxhash64("doc_id"), 24)).alias("print")).where("lo < hi")
    once = whole.groupBy("members", "print").agg(F.min("key").alias("key"))
    return cut(rows.join(once.select("key", "members"), "key").select("key", "doc_id", "n", "component", "members"), "mixed", F.max("members"))


def _unfinished(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """``rows`` of the classes that are in a plausible pair which ``pairs`` (a, b, more) does not tell; those with more = 1 name them."""
    left = listed(pairs.where("more = 1").select(F.col("a").alias("doc_id")).distinct(), "unfinished")
    return rows.join(left, "doc_id", "left_semi")


def _ties(rows: DataFrame) -> DataFrame:
    """For each class the pivot, one of a bucket's two, that it meets in most buckets."""
    order = F.xxhash64("doc_id")
    pivots = rows.groupBy("key").agg(F.min_by("doc_id", order).alias("x"), F.max_by("doc_id", order).alias("y"))
    pivots = pivots.select("key", F.explode(F.array("x", "y")).alias("pivot"))
    ties = rows.select("key", "doc_id").join(pivots, "key").where("doc_id != pivot").groupBy("doc_id", "pivot").count()
    ties = ties.groupBy("doc_id").agg(F.max(F.struct("count", "pivot")).alias("best"))
    return ties.select(F.least("doc_id", "best.pivot").alias("a"), F.greatest("doc_id", "best.pivot").alias("b")).distinct()


def _closest(rows: DataFrame, marks: DataFrame, tries: int, every: bool, most: int) -> DataFrame:
    """Within buckets of up to ``most`` classes, in blocks of bounded size: pairs of classes of different components to try next; with more = 1, twice a class that is in a pair not told."""
    rows = rows.join(marks, "doc_id").withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id"), "blocks").cast("int"))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)) if most > BLOCK else F.lit(0))
    rows = rows.select("key", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "block", "doc_id", "n", "component", "mark")
    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(partial(_within, tries=tries, every=every), "a long, b long, more long").groupBy("a", "b").agg(F.max("more").alias("more"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs`` (doc_id, text).

    Two collections of ``SIDE`` keys, each of ``DEPTH`` minhashes, are computed; a table's key is a
    pair with one key of either collection, so ``SIDE ** 2`` tables of ``2 * DEPTH`` minhashes cost
    ``2 * SIDE * DEPTH`` minhashes. A pair at the least similarity is missed with a chance
    of 2 * (1 - 0.75 ** DEPTH) ** SIDE, about 0.0003; at 0.8 it is below 0.00003.

    Equal sets are one class from the start. Keys that no other class has are dropped before
    pairs of keys are formed. Each class is first tied to one pivot of the buckets of its single keys. Then, round by round, each class
    tries in some buckets its most alike classes of larger components it is still apart from, then the most alike class of each such component; then, in every bucket,
    the ``MORE`` most alike classes of each. Tried pairs are remembered. ``MORE`` times as many
    are tried in each round from there, by classes that have a plausible pair left that was not tried, until none has. So a large
    group of copies costs a few tries each; only pairs of classes that stay apart are all tried, and of these only such as
    neither minhashes nor parities (odd sketches, which never rule out a link) tell apart.
    A class is left out of later rounds once all its plausible pairs have been tried. Buckets are compared in blocks of bounded size.

    Null or empty text has no shingles, is linked with nothing and is its own component. Rows with
    equal doc_id are one document (their texts must agree) and all get a row; a null doc_id is not linked and has null
    component_id and kept. Other columns are ignored; an empty table gives an empty result.
    """
    signed, _ = cut(docs.select("doc_id", "text").mapInArrow(_sign, "doc_id long, n_shingles long, p0 long, p1 long, keys array<long>, mark binary"), "signed")
    full = signed.where("n_shingles > 0 and doc_id is not null")
    same = ["n_shingles", "p0", "p1"]
    classes = full.groupBy(*same).agg(F.min("doc_id").alias("rep"))
    keyed = full.join(classes.select(*same, F.col("rep").alias("doc_id")), [*same, "doc_id"], "left_semi").dropDuplicates(["doc_id"])
    marks, _ = cut(keyed.select("doc_id", "mark"), "marks")
    keys = keyed.select("doc_id", "n_shingles", F.posexplode("keys").alias("j", "h"))
    met = keys.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("h")
    keys = keys.join(met, "h", "left_semi")
    keys, _ = cut(keys.select("doc_id", F.col("n_shingles").alias("n"), F.col("h").alias("key"), "j"), "keys")
    # One array of keys per collection: at most SIDE each.
    sides = keys.groupBy("doc_id", "n").agg(
        F.collect_list(F.when(F.col("j") < SIDE, F.col("key"))).alias("one"), F.collect_list(F.when(F.col("j") >= SIDE, F.col("key"))).alias("two"))
    rows, _ = cut(
        sides.select("doc_id", "n", F.explode("one").alias("x"), "two")
        .select("doc_id", "n", F.explode("two").alias("y"), "x").select("doc_id", "n", F.xxhash64("x", "y").alias("key")), "tables")
    buckets = rows.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("key")
    rows = rows.join(buckets, "key", "left_semi")
    spark = docs.sparkSession
    linked = spark.createDataFrame([], "a long, b long")
    member = spark.createDataFrame([], "node long, component long")
    tried, total = linked, 0
    turn, tries = 0, TRIES
    while True:
        # Ties need no pairs of keys: the buckets of single ones are an eighth as many rows, and their pivots meet more classes.
        named = ["key", "doc_id", "n"]
        mixed, most = _labelled((rows if turn else keys).select(*named), member)
        every = turn > 1
        # Like classes share many buckets, and would be told in each of them; the rounds after these two use all.
        used = mixed.where(F.pmod(F.xxhash64("key"), F.lit(FIRST)) == 0) if turn in (1, 2) else mixed
        pairs, more = cut(_closest(used, marks, tries, every, most), "closest", F.max("more")) if turn else (plausible(_ties(mixed), marks), 1)
        rows = _unfinished(mixed, pairs) if turn > 2 else mixed if turn else rows
        pairs = pairs.where("a != b").select("a", "b").join(F.broadcast(tried) if total <= LISTED else tried, ["a", "b"], "left_anti")
        new, found, near, many = confirmed(docs, pairs)
        linked, tried, total = linked.union(new), tried.union(near), total + many
        member = listed(components(linked), "member") if found else member
        if turn > 2 and not more:
            break
        turn += 1
        # Large components are linked by the most alike class of each, before more are told at once.
        tries = 1 if turn == 2 else MORE ** (turn - 2) if turn > 2 else tries
    of = classes.join(member, F.col("rep") == F.col("node"), "left").select(*same, F.coalesce("component", "rep").alias("top"))
    out = signed.drop("keys", "mark").join(of, same, "left")
    top = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("top")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", top.alias("component_id"), (F.col("doc_id") == top).alias("kept"))
