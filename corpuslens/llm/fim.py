"""Fill in the middle: cuts at unit boundaries, found by a piecewise-linear rank index with exact corrections."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslens.llm.common import texts

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
BOUND = 64  # bytes that a segment's line may be off by
PIECE = 64  # boundaries that a segment is first tried on; tries double


class RankIndex(NamedTuple):
    """Offsets of boundaries by rank: segments (first rank, its offset, slope) and the residual of every rank."""

    first: np.ndarray
    base: np.ndarray
    slope: np.ndarray
    residual: np.ndarray

    def predict(self, ranks: np.ndarray) -> np.ndarray:
        """Offsets by the lines alone, off by ``bound`` at most (and one for rounding)."""
        s = np.searchsorted(self.first, ranks, "right") - 1
        return self.base[s] + np.floor(self.slope[s] * (ranks - self.first[s])).astype(np.int64)

    def at(self, ranks: np.ndarray) -> np.ndarray:
        """Exact offsets."""
        return self.predict(ranks) + self.residual[ranks]


def fit(offsets: np.ndarray, bound: int = BOUND) -> RankIndex:
    """Index of rising ``offsets``: each segment goes on while one line through its first point stays within ``bound`` of all.

    The slopes that do form a cone which only narrows, so its running ends tell where a segment has to stop. Every boundary is
    looked at a bounded number of times."""
    first, slope = [], []
    i, n = 0, len(offsets)
    while i < n:
        low, high, j, step = -np.inf, np.inf, i + 1, PIECE
        while j < n:
            run = np.arange(j, min(j + step, n)) - i
            rise = offsets[j: j + len(run)] - offsets[i]
            lows = np.maximum(np.maximum.accumulate((rise - bound) / run), low)
            highs = np.minimum(np.minimum.accumulate((rise + bound) / run), high)
            out = np.flatnonzero(lows > highs)
            good = int(out[0]) if len(out) else len(run)
            if good:
                low, high = lows[good - 1], highs[good - 1]
            j += good
            if len(out):
                break
            step *= 2
        first.append(i)
        slope.append((low + high) / 2 if j > i + 1 else 0.0)
        i = j
    ranks = np.array(first, np.int64)
    rough = RankIndex(ranks, offsets[ranks], np.array(slope), np.zeros(0, np.int64))
    off = offsets - rough.predict(np.arange(n))
    small = np.min_scalar_type(-int(np.abs(off).max(initial=0)) - 1)  # as narrow as the residuals are
    return rough._replace(residual=off.astype(small))


def boundaries(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of all unit boundaries of the texts ``data[offsets[i]:offsets[i+1]]``, and the first rank of each text.

    Units are lines with their newline, and what is left after the last one; a text of n units has n + 1 boundaries."""
    begins, ends = offsets[:-1], offsets[1:]
    after = np.flatnonzero(data == 10) + 1
    # A text that ends with a newline has its end among them already.
    open_ = (ends > begins) & (data[np.maximum(ends - 1, 0)] != 10) if len(data) else np.zeros(len(begins), bool)
    owner = np.searchsorted(ends, after, "left")
    rows = np.arange(len(begins))
    at = np.concatenate([begins, after, ends[open_]])
    of = np.concatenate([rows, owner, rows[open_]])
    order = np.lexsort((at, of))
    return at[order], np.searchsorted(of[order], np.arange(len(begins) + 1), "left")


def _draws(salt: str, doc_id: object) -> tuple[int, int, int, int]:
    digest = hashlib.sha256(f"{salt}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[k: k + 4]) for k in (0, 4, 8, 12))


def _chars(data: np.ndarray) -> int:
    return len(data) - int(np.count_nonzero((data & 0xC0) == 0x80))


def _cut(batches: Iterator[pa.RecordBatch], names: list[str], key: str, text: str, salt: str, rate: int, spm: int, bound: int) -> Iterator[pa.RecordBatch]:
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    for batch in batches:
        keys = batch.column(batch.schema.get_field_index(key)).to_pylist()
        null = batch.column(batch.schema.get_field_index(text)).is_null().to_pylist()
        for row, data, offsets in texts(batch, text):
            count = len(offsets) - 1
            at, ranks = boundaries(data, offsets)
            index = fit(at, bound)
            n = np.diff(ranks) - 1
            draws = [_draws(salt, k) for k in keys[row: row + count]]
            ends = np.array([sorted((d[0] % (k + 1), d[1] % (k + 1))) for d, k in zip(draws, n.tolist(), strict=True)], np.int64).reshape(-1, 2)
            cuts = index.at(ranks[:-1, None] + ends)
            out, form, before, between = [], [], [], []
            for i, (lo, hi) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                whole = data[lo:hi].tobytes()
                a, b = cuts[i].tolist()
                if not whole or p in whole or s in whole or m in whole or draws[i][2] % 100 >= rate:
                    out.append(None if null[row + i] else whole)
                    form.append("plain")
                    before.append(None)
                    between.append(None)
                    continue
                head, mid, tail = whole[: a - lo], whole[a - lo: b - lo], whole[b - lo:]
                last = draws[i][3] % 100 < spm
                out.append(b"".join((s, tail, p, head, m, mid) if last else (p, head, s, tail, m, mid)))
                form.append("spm" if last else "psm")
                before.append(_chars(data[lo:a]))
                between.append(_chars(data[a:b]))
            made = {text: pa.array(out, pa.binary()).cast(pa.string(), safe=False), "n": pa.array(n, pa.int64()), "form": pa.array(form, pa.string()),
                    "prefix_chars": pa.array(before, pa.int64()), "middle_chars": pa.array(between, pa.int64())}
            part = batch.slice(row, count)
            yield pa.RecordBatch.from_arrays([made[c] if c in made else part.column(part.schema.get_field_index(c)) for c in names], names)


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", salt: str = "7", rate: int = 100, spm: int = 50, bound: int = BOUND) -> DataFrame:
    """``docs`` with ``text`` reordered for filling in the middle, and n, form, prefix_chars and middle_chars.

    A text of n lines is cut after a and b of them, a <= b, both drawn from the hash of its key. Of all texts ``rate`` per cent
    are reordered, and ``spm`` per cent of these have the suffix first; the others, empty texts and texts that hold one of the three
    marks stay plain, with null lengths. Lengths are code points.

    Boundaries of a slice of whole texts are one rank index: straight segments within ``bound`` bytes of every boundary, which
    predict the cuts of all its texts at once, and stored residuals that put each right exactly. Nothing is shuffled, a
    slice is about one MB (a longer text is a slice of its own), and whole texts are cut.

    Null text stays null, with n 0 and form plain. A null key draws from the hash of the empty name. Repeated rows give equal results;
    an empty table gives an empty result. Other columns stay; those named like a result are replaced by it.
    """
    added = T.StructType().add("n", "long").add("form", "string").add("prefix_chars", "long").add("middle_chars", "long").fields
    fresh = {f.name for f in added}
    kept = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in fresh))
    schema = T.StructType([*kept.schema.fields, *added])
    names = schema.names
    return kept.mapInArrow(lambda b: _cut(b, names, key, text, salt, rate, spm, bound), schema)


def restored(text: Column, form: Column) -> Column:
    """The text that was cut, from its output and form alone. Marks cannot arise at joints, as only their first sign is ``<``."""
    first, second = len(PREFIX), len(SUFFIX)
    p, s, m = (F.locate(x, text) for x in (PREFIX, SUFFIX, MIDDLE))
    middle = F.substr(text, m + len(MIDDLE))
    psm = F.concat(F.substr(text, F.lit(first + 1), s - first - 1), middle, F.substr(text, s + second, m - s - second))
    spm = F.concat(F.substr(text, p + first, m - p - first), middle, F.substr(text, F.lit(second + 1), p - second - 1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(text)


SQL = r"""
  WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
  u AS (SELECT *, CASE WHEN text = '' THEN [] ELSE regexp_extract_all(text, '[^\n]*\n|[^\n]+') END AS units FROM d),
  r AS (SELECT *, len(units) AS n, [CAST('0x' || h[8 * k + 1 : 8 * k + 8] AS BIGINT) FOR k IN range(4)] AS hs FROM u),
  c AS (SELECT *, least(hs[1] % (n + 1), hs[2] % (n + 1)) AS a, greatest(hs[1] % (n + 1), hs[2] % (n + 1)) AS b,
      CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR hs[3] % 100 >= 100 THEN 'plain'
           WHEN hs[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM r),
  s AS (SELECT *, array_to_string(units[1 : a], '') AS pre, array_to_string(units[a + 1 : b], '') AS mid, array_to_string(units[b + 1 :], '') AS suf FROM c)
  SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars,
    CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                     ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
    sha256(text) AS restored_sha256
  FROM s"""
