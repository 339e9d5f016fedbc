"""Chat formatting proved by a round trip: rendered turns are parsed again, and conflicting texts escaped until they come back."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# (role, how its turn begins, how it ends); any other role is named in its mark.
MARKS = {"system": ("[SYS] ", " [/SYS]"), "user": ("[INST] ", " [/INST]"), "assistant": ("[OUT] ", " </s>")}
OTHER = ("[AS ", "] ", " [/AS]")
TRAINED = "assistant"
_CONTROL = re.compile(r"\\[\\\[<\]]|\[/?(?:SYS|INST|OUT|AS)\b|</?s>")
_ESCAPED = re.compile(r"\\([\\\[<\]])")


def escape(text: str) -> str:
    return re.sub(r"[\\\[<\]]", r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def _mark(role: str) -> tuple[str, str]:
    return MARKS.get(role) or (OTHER[0] + escape(role) + OTHER[1], OTHER[2])


def parse(text: str) -> list[tuple[str, str, int, int]] | None:
    """(role, text, begin, end of the text as written) of each turn of a formatted string, or None if it isn't one.

    A turn is its opening mark, text without a bare control string, its closing mark and a line end; nothing else may stand anywhere.
    """
    out, at = [], 0
    while at < len(text):
        role = next((r for r, (o, _) in MARKS.items() if text.startswith(o, at)), None)
        if role is not None:
            begin, close = at + len(MARKS[role][0]), MARKS[role][1]
        elif text.startswith(OTHER[0], at):
            named = re.compile(r"((?:[^\\\[<\]]|\\.)*)\] ", re.S).match(text, at + len(OTHER[0]))
            if not named:
                return None
            role, begin, close = unescape(named[1]), named.end(), OTHER[2]
            if role in MARKS:
                return None
        else:
            return None
        # The first bare control string has to be the closing mark.
        seek = begin
        while (found := _CONTROL.search(text, seek)) and found[0][0] == "\\":
            seek = found.end()
        if not found or found.start() == begin - 1 or not text.startswith(close + "\n", found.start() - 1) or found.start() - 1 < begin:
            return None
        end = found.start() - 1
        out.append((role, unescape(text[begin:end]), begin, end))
        at = end + len(close) + 1
    return out


def render(role: str, text: str) -> str:
    """One turn. The text stays as it is unless the parser then reads another turn from it."""
    before, after = _mark(role)
    plain = f"{before}{text}{after}\n"
    got = parse(plain)
    if got is not None and [t[:2] for t in got] == [(role, text)]:
        return plain
    return f"{before}{escape(text)}{after}\n"


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        shown = [render(r or "", t or "") for r, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(shown, pa.string())], ["conv_id", "turn", "shown"])


def formatted(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, shown): each row of ``turns`` (conv_id, turn, role, text) as it is written; a conversation is its rows' ``shown`` in order.

    Null role or text counts as empty. Rendering moves no rows."""
    return turns.select("conv_id", "turn", "role", "text").mapInArrow(_render, "conv_id long, turn long, shown string")


class _Reader:
    """Digests of one conversation, read back from its formatted text piece by piece."""

    def __init__(self) -> None:
        self.turns, self.chars, self.trained = 0, 0, 0
        self.every, self.loss = hashlib.sha256(), hashlib.sha256()
        self.rest: list[str] = []

    def add(self, shown: str) -> None:
        self.rest.append(shown)
        if len(self.rest) >= 64:
            self.flush()

    def flush(self) -> None:
        whole = "".join(self.rest)
        got = parse(whole)
        if got is None or len(got) != len(self.rest):
            raise ValueError("formatted text does not parse")
        for role, text, begin, end in got:
            self.every.update(f"{role}\n{text}\n".encode())
            if role == TRAINED:  # the loss mask covers [begin, end) of the formatted text
                under = unescape(whole[begin:end])
                self.loss.update(under.encode())
                self.trained += len(under)
        self.turns, self.chars, self.rest = self.turns + len(got), self.chars + len(whole), []

    def row(self) -> tuple[int, str, int, str, int]:
        self.flush()
        return self.turns, self.every.hexdigest(), self.trained, self.loss.hexdigest(), self.chars


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def done(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    now: tuple[int | None, _Reader] | None = None
    rows: list[tuple] = []
    for b in batches:
        for conv, shown in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if now is None or now[0] != conv:
                if now is not None:
                    rows.append((now[0], *now[1].row()))
                now = (conv, _Reader())
            now[1].add(shown)
        if len(rows) >= 1000:
            yield done(rows)
            rows = []
    if now is not None:
        yield done([*rows, (now[0], *now[1].row())])


def read_back(shown: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of each conversation of ``formatted`` rows.

    Rows are read in order of turn, nulls first, equal turns in order of their text as written. A conversation
    of any length streams through its task, a few turns in memory at a time. A null conv_id is a conversation of its own;
    repeated rows are turns each; an empty table gives an empty result.
    """
    rows = shown.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "shown").select("conv_id", "shown")
    return rows.mapInArrow(_read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def digests(turns: DataFrame) -> DataFrame:
    """What is read back from the formatted form of all conversations of ``turns``."""
    return read_back(formatted(turns.withColumn("conv_id", F.col("conv_id").cast("long"))))
