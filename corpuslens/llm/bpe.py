"""BPE encoding by dynamic programming over prefixes, and decoding."""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache, partial

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "word_bpe_49k.json"
WORDS_KEPT = 100_000  # encoded words a task remembers before it starts anew

# White space as the tokenizer's patterns take it, and its pattern of pieces.
_BLANK = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^" + _BLANK + r"\p{L}\p{N}]+"


def _byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte, as letter to byte."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Words(dict):
    """Encoded pieces by word, filled as they are asked for: (ids as text, tokens as text, number of ids)."""

    def __init__(self, path: str) -> None:
        super().__init__()
        with open(path, encoding="utf-8") as f:
            conf = json.load(f)
        model = conf["model"]
        end = model["end_of_word_suffix"]
        byte_of = _byte_letters()
        # A word is a string of units: a byte, or 256 more for the byte that ends the word.
        units = {}
        for token in model["vocab"]:
            body, last = (token[: -len(end)], 256) if token.endswith(end) and token != end else (token, 0)
            if all(c in byte_of for c in body):
                raw = [byte_of[c] for c in body]
                units[token] = "".join(map(chr, [*raw[:-1], raw[-1] + last]))
        self.token = {i: t for t, i in model["vocab"].items()}
        id_of = {u: model["vocab"][t] for t, u in units.items()}
        self.rank: dict[int, int] = {i: -1 for i in id_of.values()}
        self.made: dict[int, tuple[int, int]] = {}
        self.joins: dict[tuple[int, int], int] = {}
        for r, (a, b) in enumerate(model["merges"]):
            x, y, z = model["vocab"][a], model["vocab"][b], id_of[units[a] + units[b]]
            self.joins.setdefault((x, y), r)
            if z not in self.made:
                self.made[z], self.rank[z] = (x, y), r
        self.fits: dict[int, bool] = {}
        self.single = ahocorasick.Automaton()
        for u, i in id_of.items():
            # Only tokens that stand for themselves can end a prefix.
            if len(u) == 1 or (i in self.made and self.itself(i)):
                self.single.add_word(u, (i, len(u)))
        self.single.make_automaton()
        self.whole = {u: i for u, i in id_of.items() if u in self.single}
        added = {t["content"]: t["id"] for t in conf["added_tokens"]}
        self.token |= {i: t for t, i in added.items()}
        self.added = {t: (str(i), t, 1) for t, i in added.items()}
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.pieces = regex.compile(_PIECES)

    def itself(self, i: int) -> bool:
        """Whether the parts of a token's making can stand side by side until they are joined."""
        x, y = self.made[i]
        return self.together(x, y, self.rank[i])

    def together(self, x: int, y: int, until: float = float("inf")) -> bool:
        """Whether no join crosses the border of tokens ``x`` and ``y`` before step ``until``.

        Goes back in time: the later of the two is taken apart, and a join of what then stood at the border must not come
        before that. Equal joins run from left to right, so one that overlaps the right token's own goes first.
        """
        while True:
            if self.joins.get((x, y), until) < until:
                return False
            if self.rank[x] > self.rank[y]:
                until, x = self.rank[x], self.made[x][1]
            elif self.rank[y] >= 0:
                until, y = self.rank[y] + 1, self.made[y][0]
            else:
                return True

    def encode(self, word: str) -> list[int]:
        """Ids of one piece: the last token of every prefix is the one that fits behind the last token before it."""
        raw = word.encode("utf-8").decode("latin-1")
        raw = raw[:-1] + chr(ord(raw[-1]) + 256)
        if (i := self.whole.get(raw)) is not None:
            return [i]
        ends, lengths = [-1] * (len(raw) + 1), [0] * (len(raw) + 1)
        fits, done = self.fits, 0
        for at, (i, n) in self.single.iter(raw):
            if at < done:
                continue
            if at >= n:
                before = ends[at + 1 - n]
                key = before << 20 | i
                ok = fits.get(key)
                if ok is None:
                    ok = fits[key] = before >= 0 and self.together(before, i)
                if not ok:
                    continue
            done = at + 1
            ends[done], lengths[done] = i, n
        ids, at = [], len(raw)
        while at:
            ids.append(ends[at])
            at -= lengths[at]
        return ids[::-1]

    def __missing__(self, word: str) -> tuple[str, str, int]:
        if len(self) >= WORDS_KEPT:
            self.clear()
        if len(self.fits) >= 4 * WORDS_KEPT:
            self.fits.clear()
        ids = self.encode(word)
        found = self[word] = (" ".join(map(str, ids)), " ".join([self.token[i] for i in ids]), len(ids))
        return found

    def of(self, text: str) -> list[tuple[str, str, int]]:
        """The encoded pieces of a whole text."""
        if self.split is not None and "<" in text:
            out = []
            for k, part in enumerate(self.split.split(text)):
                out += [self.added[part]] if k % 2 else self._of(part)
            return out
        return self._of(text)

    def _of(self, text: str) -> list[tuple[str, str, int]]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # no special final sigma
        return [self[w] for w in self.pieces.findall(text.lower())]


@lru_cache(maxsize=2)
def words(path: str) -> Words:
    return Words(path)


def _encode(batches: Iterator[pa.RecordBatch], path: str, keep: bool) -> Iterator[pa.RecordBatch]:
    import public_tokenizers  # resolved where the task runs

    known = words(path if "/" in path else public_tokenizers.path(path))
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            n, ids, back = [], [], []
            for text in part.column(part.num_columns - 1):
                found = known.of(text.as_py() or "")
                n.append(sum([x[2] for x in found]))
                ids.append(" ".join([x[0] for x in found]))
                back.append(" ".join([x[1] for x in found]))
            digest = lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()
            more = [pa.array(n, pa.int64()), pa.array([digest(x) for x in ids]), pa.array([digest(x) for x in back])]
            names = ["n_tokens", "ids_sha256", "decoded_sha256"]
            if keep:
                more += [pa.array([list(map(int, x.split())) for x in ids], pa.list_(pa.int32())), pa.array(back, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays([part.column(0), *more], [part.schema.names[0], *names])


def encode(docs: DataFrame, path: str = VOCABULARY, keep: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row of ``docs`` (doc_id, text); with ``keep`` also ids and decoded.

    ``path`` is a vocabulary file that every executor has, or the name of a public one. For every prefix of a piece the one last token is
    stored that can stand there: an automaton over the vocabulary gives the tokens that end the prefix, and a pair test
    against the last token of what is left tells which of them merging would produce. Following the stored tokens back gives exactly the ids of merging. Decoding
    joins the tokens' texts with spaces, as the vocabulary has no decoder.

    One pass without a shuffle. Null or empty text has no tokens and the digests of the empty string; strings of
    special tokens become their ids. Every row is encoded whatever its doc_id; other columns are ignored; an empty table gives an
    empty result.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(partial(_encode, path=path, keep=keep), schema)
