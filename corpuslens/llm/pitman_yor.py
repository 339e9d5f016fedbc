"""Language-model scores: a hierarchical Pitman-Yor model whose restaurants are seated by Gibbs sampling."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuslens.llm.common import listed, longs, mix, span_hashes, texts, word_spans
from corpuslens.session import cut, freeing, scratch_path
from corpuslens.skew import SALTS

DOCUMENTS = 4_096  # documents of a chunk, whose pairs are asked for together; a power of two
BATCH = 1 << 16  # rows of a batch of pairs
STRENGTH = 1.0  # concentration of every restaurant
BURN = 3  # sweeps before those that are averaged
SAMPLES = 3  # sweeps that are averaged
EXACT = 1024  # customers of a dish up to which seatings are counted one by one
_ROOTS, _BACKS = ([f"{c}_{k}" for k in range(SAMPLES)] for c in ("root", "back"))
_STATS = ("count", "held", *_ROOTS, *_BACKS)
_LOW = np.uint64((1 << 32) - 1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_END = span_hashes(np.frombuffer(b"\n", np.uint8), np.array([0]), np.array([1]))[0]  # no word has a line end


@lru_cache(maxsize=8)
def _rises(discount: float) -> np.ndarray:
    """[n, t] log S(n, t + 1) - log S(n, t), up to n = ``EXACT``: S sums, over the seatings of n customers at t tables, what the tables' sizes weigh."""
    at = np.arange(EXACT + 2)
    log, out = np.full(EXACT + 2, -np.inf), np.full((EXACT + 1, EXACT + 1), -np.inf)
    log[1] = 0
    for n in range(1, EXACT + 1):
        out[n, 1:n] = np.diff(log[1: n + 1])
        with np.errstate(divide="ignore"):
            log[1:] = np.logaddexp(log[1:] + np.log(np.maximum(n - discount * at[1:], 0)), log[:-1])
    return out


@lru_cache(maxsize=8)
def _saddle(discount: float) -> tuple[np.ndarray, np.ndarray]:
    """log(n / t - 1) and the saddle point's log of what one more table multiplies S(n, t) * discount * t by."""
    u = np.concatenate([-np.expm1(-np.logspace(-9, 1, 1000)), -np.expm1(-np.logspace(1, 1.5, 20))])
    u = np.unique(np.concatenate([1 - u, np.logspace(-40, -1, 2000)]))[::-1]
    u = u[(u > 0) & (u < 1)]
    more = (1 - u) * discount * u ** (discount - 1) / -np.expm1(discount * np.log(u)) - 1
    keep = more > 1e-7
    return np.log(more[keep]), np.log(-np.expm1(discount * np.log(u[keep])))


def rise(many: np.ndarray, tables: np.ndarray, discount: float) -> np.ndarray:
    """What one more table than ``tables`` multiplies the weight of all seatings of ``many`` customers by, as a log; falls in ``tables``.

    Up to ``EXACT`` customers as counted. Beyond, by the saddle point, whose error is read off the last counted row at the same t / n ** discount."""
    table = _rises(discount)
    few = np.minimum(many, EXACT).astype(np.int64)
    got = table[few, np.minimum(tables, EXACT).astype(np.int64)]
    big = many > EXACT
    if big.any():
        saddle = lambda n, t: np.interp(np.log(np.maximum(n / t - 1, 1e-12)), *_saddle(discount)) - np.log(discount * t)
        at = np.arange(1.0, EXACT)
        wrong = np.append(0, table[EXACT, 1:EXACT] - saddle(EXACT, at))
        n, t = many[big], tables[big].astype(np.float64)
        got[big] = np.where(t < n, saddle(n, t) + np.interp(t * (EXACT / n) ** discount, np.arange(EXACT // 2), wrong[: EXACT // 2]), -np.inf)
    return got


def tables_of(many: np.ndarray, base: np.ndarray, discount: float, rng: np.random.Generator, grow: np.ndarray | float = 0.0) -> np.ndarray:
    """A sampled number of tables of each dish, given all other dishes.

    ``many`` are a dish's customers. A table beyond the t that the dish has weighs ``base + grow * t``: (concentration + discount * the
    restaurant's tables) * the parent's chance. All customers of a dish are seated anew: the number of tables is drawn from its chance over
    all seatings, which moves of single customers by the Chinese restaurant rule tend to, for any number of customers.
    """
    out = (many > 0).astype(np.float64)
    more = np.flatnonzero(many > 1)
    n, start = many[more].astype(np.float64), base[more].astype(np.float64)
    rising = np.broadcast_to(np.asarray(grow, np.float64), many.shape)[more]

    def step(of: np.ndarray, t: np.ndarray) -> np.ndarray:
        """log of how much likelier one more table than ``t`` is; falls in ``t``."""
        wide = (slice(None), *[None] * (t.ndim - 1))
        return np.log(start[of][wide] + rising[of][wide] * t) + rise(np.broadcast_to(n[of][wide], t.shape), t, discount)

    # The likeliest number: the last that is more likely than one less.
    lo, hi = np.ones(len(more)), n.copy()
    while (open_ := np.flatnonzero(lo < hi)).size:
        mid = np.floor((lo[open_] + hi[open_]) / 2)
        up = step(open_, mid) > 0
        lo[open_], hi[open_] = np.where(up, mid + 1, lo[open_]), np.where(up, hi[open_], mid)
    # Steps fall away from it, so half the way lies behind a point by half the way's steps at least: on to a chance of e ** -30.
    reach = np.ceil(8 * np.sqrt(lo) + 12)
    open_ = np.arange(len(more))
    while open_.size:
        half = np.floor(reach[open_] / 2)
        up, down = lo[open_] + half, lo[open_] - half
        fine = (up >= n[open_]) | (half * step(open_, np.minimum(up, n[open_])) < -30)
        fine &= (down <= 1) | (half * step(open_, np.maximum(down, 1)) > 30)
        open_ = open_[~fine]
        reach[open_] *= 2
    first, last = np.maximum(lo - reach, 1), np.minimum(lo + reach, n)
    order, s = np.argsort(last - first, kind="stable")[::-1], 0
    while s < len(order):
        wide = int(last[order[s]] - first[order[s]]) + 1
        at = order[s: s + max(1, (1 << 20) // wide)]
        s += len(at)
        t = first[at][:, None] + np.arange(wide - 1)
        log = np.where(t < last[at][:, None], step(at, np.minimum(t, n[at][:, None])), -np.inf)
        log = np.cumsum(np.concatenate([np.zeros((len(at), 1)), log], axis=1), axis=1)
        chance = np.cumsum(np.exp(log - log.max(axis=1)[:, None]), axis=1)
        out[more[at]] = first[at] + (chance <= (rng.random(len(at)) * chance[:, -1])[:, None]).sum(axis=1)
    return out


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, word hash, context) of each token. A context is the hash of the word before the token, at the start of a text that of an end."""
    starts, ends = word_spans(data, offsets)
    n = len(offsets) - 1
    of = np.searchsorted(offsets, starts, "right") - 1
    words = _hashed(data, starts, ends)
    # An end goes behind each text's words, and so before the next text's first.
    of, words = np.concatenate([of, np.arange(n)]), np.concatenate([words, np.full(n, _END, np.uint64)])
    order = np.argsort(of, kind="stable")
    of, words = of[order], words[order]
    return of, words, np.concatenate([[_END], words[:-1]])


def _hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Word hashes, a part of a long text at a time."""
    out, s = [np.zeros(0, np.uint64)], 0
    while s < len(starts):
        e = max(s + 1, int(np.searchsorted(ends, starts[s] + (1 << 20), "right")))
        a, b = int(starts[s]), int(ends[e - 1])
        out.append(span_hashes(data[a:b], starts[s:e] - a, ends[s:e] - a))
        s = e
    return np.concatenate(out)


def _keys(words: np.ndarray, contexts: np.ndarray) -> np.ndarray:
    return mix(words + contexts * _STEP)


def _sorted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of ``keys`` and where in it each of them begins."""
    order = np.argsort(keys)
    k = keys[order]
    return order, np.flatnonzero(np.concatenate([np.ones(min(len(k), 1), bool), k[1:] != k[:-1]]))


class _Places:
    """Where hashes stand among sorted ones. Their first bits tell nearly, as hashes are spread evenly."""

    def __init__(self, keys: np.ndarray):
        bits = max(len(keys).bit_length(), 1)
        self.keys, self.shift = keys, np.uint64(64 - bits)
        self.begin = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << self.shift)

    def of(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, whether it is there) of each."""
        at = np.minimum(self.begin[(asked >> self.shift).astype(np.int64)], max(len(self.keys) - 1, 0))
        if not len(self.keys):
            return at, np.zeros(len(asked), bool)
        open_ = np.flatnonzero(self.keys[at] < asked)
        while open_.size:
            open_ = open_[at[open_] < len(self.keys) - 1]
            at[open_] += 1
            open_ = open_[self.keys[at[open_]] < asked[open_]]
        return at, self.keys[at] == asked


def _rows(columns: dict[str, pa.Array]) -> Iterator[pa.RecordBatch]:
    yield from pa.table(columns).to_batches(max_chunksize=BATCH)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, context, chunk, seen, asked, head): each pair of a chunk once or a few times, with its number in learned texts and whether others hold it.

    ``head`` marks one row, or a few, of each word of a chunk."""
    parts: list[tuple[np.ndarray, ...]] = []
    now, held = None, 0

    def merged() -> tuple[np.ndarray, ...]:
        w, c, seen, asked = (np.concatenate(x) for x in zip(*parts, strict=True))
        order, first = _sorted(_keys(w, c))
        one = order[first]
        return w[one], c[one], np.add.reduceat(seen[order], first), np.logical_or.reduceat(asked[order], first)

    def rows() -> Iterator[pa.RecordBatch]:
        w, c, seen, asked = merged()
        at = np.argsort(w & ~_LOW | c & _LOW)  # equal words side by side pack better
        head = np.concatenate([[True], w[at][1:] != w[at][:-1]])
        chunk = pa.array(np.full(len(w), now), pa.int64())
        yield from _rows({"word": pa.array(longs(w[at])), "context": pa.array(longs(c[at])), "chunk": chunk, "seen": pa.array(seen[at]), "asked": pa.array(asked[at]), "head": pa.array(head)})

    for batch in batches:
        chunks, learn = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
        for at, data, offsets in texts(batch):
            of, w, c = _tokens(data, offsets)
            mine, learned = chunks[at + of], learn[at + of]
            for chunk in np.unique(mine):
                if parts and chunk != now:
                    yield from rows()
                    parts, held = [], 0
                elif held > 1 << 21:  # tokens since pairs were last merged
                    parts, held = [merged()], 0
                    if len(parts[0][0]) > 1 << 21:
                        yield from rows()
                        parts = []
                m = mine == chunk
                now, held = int(chunk), held + int(m.sum())
                parts.append((w[m], c[m], learned[m].astype(np.int64), ~learned[m]))
    if parts:
        yield from rows()


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about ``BATCH`` rows from smaller ones, as a few numbers to a row cost less at once."""
    some: list[pa.RecordBatch] = []
    for batch in batches:
        some.append(batch)
        if sum(b.num_rows for b in some) >= BATCH:
            yield pa.Table.from_batches(some).combine_chunks().to_batches()[0]
            some = []
    if sum(b.num_rows for b in some):
        yield pa.Table.from_batches(some).combine_chunks().to_batches()[0]


def _drawn(batches: Iterator[pa.RecordBatch], many: str, discount: float, sweep: int) -> Iterator[pa.RecordBatch]:
    """Rows of dishes with sampled ``tables`` in place of their columns base and grow. The first column identifies a dish in part."""
    for batch in _together(batches):
        rng = np.random.default_rng([int(batch.column(0)[0].as_py()) & 0x7FFFFFFF, batch.num_rows, sweep])
        n, base, grow = (batch.column(c).to_numpy() for c in (many, "base", "grow"))
        kept = [c for c in batch.schema.names if c not in ("base", "grow")]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(tables_of(n, base, discount, rng, grow))], [*kept, "tables"])


def _sweeps(pairs: DataFrame, many: int, types: int, discounts: tuple[float, float]) -> tuple[DataFrame, DataFrame, DataFrame, list[tuple[int, int]]]:
    """The chain: (word, context, learned, total) of pairs learned more than once, (word, count, mass) and (context, held, rooms), and the root's customers and tables.

    ``total`` are a pair's tables over the last ``SAMPLES`` sweeps. ``mass`` (the root's customers less their discount), ``rooms`` and the list have a
    value for each of them. At first every dish has one table. A sweep seats every pair anew, given the context's tables and the word's
    chance at the root without the pair's own; the tables that it takes are the root's customers, who are seated anew in turn. All
    of a sweep's pairs are drawn at once, given the sweep before. A pair learned once has one table in every sweep and is only counted;
    contexts that have no others, and words in one such pair alone, stay as they are and take no part in the sweeps.
    """
    low, high = discounts
    outcomes = types + 1.0
    customers, seats = many, types
    none = F.array().cast("array<double>")
    once = F.count_if(F.col("learned") == 1).cast("double")
    n = F.count(F.lit(1)).cast("double")
    most = F.max("learned").alias("most")
    of_word, _ = cut(pairs.groupBy("word").agg(once.alias("fixed"), F.sum("learned").alias("count"), n.alias("many"), most), "words")
    of_context, _ = cut(pairs.groupBy("context").agg(once.alias("fixed"), F.sum("learned").alias("held"), n.alias("now"), most), "contexts")
    one = F.lit(1.0)
    lone = (F.col("many") == 1) & (F.col("most") == 1)
    alone = of_word.where(lone).count()
    words = listed(of_word.where(~lone).select("word", "fixed", "count", "many", none.alias("mass"), one.alias("tables")), "words")
    contexts = listed(of_context.where("most > 1").select("context", "fixed", "held", "now", none.alias("rooms")), "contexts")
    seated = pairs.where("learned > 1").select("word", "context", "learned", F.lit(0.0).alias("total"), one.alias("tables"))
    totals: list[tuple[int, int]] = []
    for sweep in range(BURN + SAMPLES):
        kept = sweep >= BURN
        own, at_root = F.col("tables"), F.col("_many")
        chance = ((at_root - low * F.col("_seats")) * (at_root - own) / at_root + (STRENGTH + low * seats) / outcomes) / (STRENGTH + customers - own)
        asked = seated.join(contexts.select("context", "now"), "context").join(
            words.select("word", F.col("many").alias("_many"), F.col("tables").alias("_seats")), "word").withColumn("_chance", chance)
        asked = asked.select("word", "context", "learned", "total", ((STRENGTH + high * (F.col("now") - own)) * F.col("_chance")).alias("base"), (high * F.col("_chance")).alias("grow"))
        drawn = asked.mapInArrow(partial(_drawn, many="learned", discount=high, sweep=sweep), "word long, context long, learned long, total double, tables double")
        seated, _ = cut(drawn.withColumn("total", F.col("total") + F.col("tables")) if kept else drawn, "seated")
        taken = lambda c: seated.groupBy(c).agg(F.sum("tables").alias("_taken"))
        now = F.col("fixed") + F.coalesce("_taken", F.lit(0.0))
        contexts = contexts.join(taken("context"), "context", "left").select("context", "fixed", "held", now.alias("now"), "rooms")
        contexts = listed(contexts.withColumn("rooms", F.array_append("rooms", F.col("now"))) if kept else contexts, "contexts")
        asked = words.join(taken("word"), "word", "left").select(
            "word", "fixed", "count", now.alias("many"), "mass", ((STRENGTH + low * (seats - F.col("tables"))) / outcomes).alias("base"), F.lit(low / outcomes).alias("grow"))
        words = asked.mapInArrow(partial(_drawn, many="many", discount=low, sweep=sweep), "word long, fixed double, count long, many double, mass array<double>, tables double")
        words = listed(words.withColumn("mass", F.array_append("mass", F.col("many") - low * F.col("tables"))) if kept else words, "words")
        customers, seats = (alone + int(v) for v in words.agg(F.coalesce(F.sum("many"), F.lit(0)), F.coalesce(F.sum("tables"), F.lit(0))).first())
        if kept:
            totals.append((customers, seats))
    still = lambda rows, *columns: rows.select(*columns[:2], F.array_repeat(columns[2], SAMPLES))
    words = words.select("word", "count", "mass").union(still(of_word.where(lone), "word", "count", one - low))
    contexts = contexts.select("context", "held", "rooms").union(still(of_context.where("most = 1"), "context", "held", F.col("fixed")))
    return seated.select("word", "context", "learned", "total"), words, contexts, totals


class Model(NamedTuple):
    """Numbers of the whole model: the share of a pair learned once, contexts' discount, outcomes of the base; per sample what the root's tables give a word, and the root's size."""

    once: float
    high: float
    outcomes: float
    even: list[float]
    size: list[float]


def _score(docs: pa.Table, known: pa.Table, model: Model) -> pa.Table:
    """Scores of a chunk's texts. ``known`` has a row (word, context, mine) per learned pair that is told, and one (word, stats) per word, also as
    a context. A learned text's pair that is not told was learned once, in that text; in others it is not known."""
    import pyarrow.compute as pc

    def sorted_by(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
        order, first = _sorted(keys)
        one = order[first]
        return keys[one], *(v[one] for v in values)

    of_word = pc.is_valid(known.column("stats"))
    pairs, words = known.filter(pc.invert(of_word)), known.filter(of_word)
    hashes = lambda t, c: t.column(c).to_numpy().view(np.uint64)
    k, mine = sorted_by(_keys(hashes(pairs, "word"), hashes(pairs, "context")), pairs.column("mine").to_numpy())
    stats = dict(zip(_STATS, (c.to_numpy() for c in words.column("stats").combine_chunks().flatten()), strict=True))
    side = lambda names: np.stack([stats[c] for c in names], axis=1)
    whole = STRENGTH + stats["held"]
    plain = np.log10((stats["count"] + 1) / model.outcomes)
    roots = (side(_ROOTS) + np.array(model.even)) / np.array(model.size)
    backs = (STRENGTH + model.high * side(_BACKS)) / whole[:, None]
    h, count, plain, whole, roots, backs = sorted_by(hashes(words, "word"), stats["count"], plain, whole, roots, backs)
    told, vocabulary = _Places(k), _Places(h)
    out = {c: [np.zeros(0)] for c in ("tokens", "known", "plain", "value")}

    def place(asked: np.ndarray) -> np.ndarray:
        at, there = vocabulary.of(asked)
        if not there.all():
            raise ValueError("a chunk of documents has changed between two readings")
        return at

    for batch in docs.to_batches():
        learn = batch.column(batch.schema.get_field_index("learn")).to_numpy(zero_copy_only=False)
        for first, data, offsets in texts(batch):
            n = len(offsets) - 1
            of, w, c = _tokens(data, offsets)
            at = place(w)
            before = np.concatenate([place(c[:1]), at[:-1]])  # a context is the word before
            own = np.where(learn[first + of], model.once, 0.0)
            if len(k):
                pair, there = told.of(_keys(w, c))
                own = np.where(there, mine[pair], own)
            # The mean over the samples of a token's chance; its own customers are the only part that no product is in.
            value = np.log10(own / whole[before] + np.einsum("ij,ij->i", backs[before], roots[at]) / SAMPLES)
            for name, v in (("tokens", None), ("known", count[at] > 0), ("plain", plain[at]), ("value", value)):
                out[name].append(np.bincount(of, v, n).astype(np.float64))
    got = {c: np.concatenate(v) for c, v in out.items()}
    return pa.table({"doc_id": docs.column("doc_id"), "learn": docs.column("learn"), "n_tokens": pa.array(got["tokens"].astype(np.int64)), "n_known": pa.array(got["known"].astype(np.int64)),
                     "base_score": pa.array(got["plain"]), "score": pa.array(got["value"])})


def _discount(once: float, twice: float) -> float:
    """The usual estimate from how many are seen once and twice, away from the ends of its range."""
    return float(np.clip(once / (once + 2 * twice), 0.1, 0.9)) if once else 0.5


def scores(docs: DataFrame, learn: Column, settled: bool = False) -> DataFrame:
    """doc_id, learned (boolean), n_tokens, n_known, train_tokens, base_score, score for each row of ``docs`` (doc_id, text).

    ``learn`` is a condition on doc_id that learned rows meet. Tokens are the words of a text, A-Z lower-cased, and one end. ``base_score`` sums
    log10((c + 1) / (N + V + 1)): V learned words and one outcome for all others. ``score`` is log10 of the text's chance over the same outcomes under a
    hierarchy of Pitman-Yor restaurants. A token's context is the word before it in its text, or the text's start; each context has a
    restaurant, as many as the learned words ask for, and all share the root as parent, whose base is even. Seatings are sampled
    by a chain of Gibbs sweeps that seat every customer anew (see :func:`_sweeps`); chances are averages over the ``SAMPLES`` sweeps after
    ``BURN``. All counts cover all learned documents.

    Learned (context, word) pairs are rows with exact counts, seated wherever they are. Documents meet the
    model by chunk: a chunk's distinct pairs and words are written once, with what is learned of them; what the sweeps make of its words and of pairs
    learned more than once comes back, so neither vocabulary nor model is held whole anywhere (a broadcast is behind a checked count). ``settled`` says that ``docs`` are files
    read as they are, which come in the same parts each time they are read; other input is written once, so that its chunks are fixed.

    Null text counts as empty: one token, the end. Rows with null or repeated doc_id are scored each; a null doc_id is learned from as ``learn`` says,
    null meaning no. Without learned rows every token has chance 1. Other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    row = F.shiftright(F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1), int(np.log2(DOCUMENTS)))
    chunk = F.spark_partition_id().cast("long") * (1 << 24) + row
    docs = docs.select(chunk.alias("chunk"), F.coalesce(learn, F.lit(False)).alias("learn"), "doc_id", "text")
    if not settled:
        path = scratch_path(spark, "chunks")
        docs.write.option("compression", "zstd").parquet(path)
        docs = spark.read.parquet(path)
    # A pair's rows meet once, by its word and a part of its contexts: what is learned of it, and which chunks ask for it.
    met = docs.select("chunk", "learn", "text").mapInArrow(_pairs, "word long, context long, chunk long, seen long, asked boolean, head boolean")
    met = met.withColumn("part", F.pmod("context", F.lit(SALTS))).repartition("word", "part")
    # One number that hardly two pairs share, in the order that they come in: sorting by it seldom looks at the rows.
    met = met.withColumn("near", F.col("word").bitwiseAND(~int(_LOW)).bitwiseOR(F.col("context").bitwiseAND(int(_LOW))))
    row = W.partitionBy("near", "word", "part", "context").orderBy("chunk")
    learned = F.sum("seen").over(row.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    with freeing(spark):
        met, _ = cut(met.select("word", "context", "chunk", "asked", "head", learned.alias("learned"), (F.row_number().over(row) == 1).alias("first")), "pairs")
        pairs = met.where("first and learned > 0").select("word", "context", "learned")
        count = lambda c, v: F.count(F.when(F.col(c) == v, 1))
        n_pairs, whole, once, twice = pairs.agg(F.count(F.lit(1)), F.coalesce(F.sum("learned"), F.lit(0)), count("learned", 1), count("learned", 2)).first()
        of_word = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
        types, ones, twos = of_word.agg(F.count(F.lit(1)), count("n", 1), count("n", 2)).first()
        low, high = _discount(ones, twos), _discount(once, twice)
        seated, words, contexts, totals = _sweeps(pairs, n_pairs, types, (low, high))
        owned = seated.select("word", "context", (F.col("learned") - high * F.col("total") / SAMPLES).cast("float").alias("mine"))
        vocabulary, _ = cut(words.withColumnRenamed("word", "h").join(contexts.withColumnRenamed("context", "h"), "h", "full"), "vocabulary")
    # Learned texts know themselves what was learned once; only others have to be told.
    own = float(np.float32(1 - high))
    asking = lambda which: met.where(which).select("chunk", "word", "context")
    told = asking("learned > 1").join(owned, ["word", "context"]).select("chunk", "word", "context", "mine").union(
        asking("learned = 1 and asked").withColumn("mine", F.lit(own).cast("float")))
    words = asking("head").drop("context").join(vocabulary, F.col("word") == F.col("h"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    roots, backs = ([zero(F.get(c, F.lit(k))).alias(of[k]) for k in range(SAMPLES)] for c, of in (("mass", _ROOTS), ("rooms", _BACKS)))
    stats = F.struct(zero("count").alias("count"), zero("held").alias("held"), *roots, *backs)
    model = Model(own, high, float(whole + types + 1), [(STRENGTH + low * t) / (types + 1.0) for _, t in totals], [STRENGTH + float(c) for c, _ in totals])
    words = words.select("chunk", "word", F.lit(None).cast("long").alias("context"), F.lit(None).cast("float").alias("mine"), stats.alias("stats"))
    told = told.withColumn("stats", F.lit(None).cast(words.schema["stats"].dataType))
    schema = "doc_id long, learn boolean, n_tokens long, n_known long, base_score double, score double"
    scored = docs.groupBy("chunk").cogroup(told.union(words).groupBy("chunk")).applyInArrow(lambda rows, known: _score(rows, known, model), schema)
    return scored.select("doc_id", F.col("learn").alias("learned"), "n_tokens", "n_known", F.lit(int(whole)).cast("long").alias("train_tokens"), "base_score", "score")


def perplexity(scored: DataFrame) -> DataFrame:
    """learned, perplexity: 10 to the power of the mean surprise per token, of learned and other documents."""
    return scored.groupBy("learned").agg(F.pow(F.lit(10.0), -F.sum("score") / F.sum("n_tokens")).alias("perplexity"))
