"""Text columns: lines, identifiers, signatures, display cuts, map clean-up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Limits and formats that results depend on.
SIGNATURE_CHARS = 200
DISPLAY_CHARS = 80
MAP_BYTES = 3000
IDENTIFIER = r"[\p{L}_][\p{L}\p{N}_]*"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# The Unicode White_Space set.
_BLANKS = r"\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
_SPACE = rf"[\x09-\x0D{_BLANKS}]"
_IN_LINE = rf"[\x09\x0B-\x0D{_BLANKS}]"


def trim_space(text: Column) -> Column:
    """Trim Unicode white space at both ends (``trim`` alone removes only blanks)."""
    return F.regexp_replace(text, f"^{_SPACE}+|{_SPACE}+\\z", "")


def trim_space_end(text: Column) -> Column:
    return F.regexp_replace(text, f"{_SPACE}+\\z", "")


def trim_space_start(text: Column) -> Column:
    return F.regexp_replace(text, f"^{_SPACE}+", "")


def is_blank(text: Column) -> Column:
    return text.rlike(f"^{_SPACE}*\\z")


def split_lines(text: Column) -> Column:
    """Array of lines: a final newline adds no line, CRLF counts as one break, '' has none."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(
        F.split(F.regexp_replace(text, r"\r?\n\z", ""), r"\r?\n", -1)
    )


def line_count(text: Column) -> Column:
    """Number of lines."""
    return F.size(split_lines(text)).cast("long")


def fold_ascii(text: Column) -> Column:
    """Lower-case A-Z only, leaving other letters as they are."""
    return F.translate(text, _UPPER, _UPPER.lower())


def is_identifier(token: Column) -> Column:
    """At least two bytes and not all ASCII digits."""
    return (F.octet_length(token) >= 2) & ~token.rlike("^[0-9]+$")


def line_tokens(line: Column) -> Column:
    """Distinct identifiers of one line."""
    found = F.array_distinct(F.regexp_extract_all(line, F.lit(IDENTIFIER), F.lit(0)))
    return F.filter(found, is_identifier)


def shorten(text: Column, limit: int) -> Column:
    """Cut to ``limit`` characters, the last three of them dots."""
    return F.when(F.length(text) <= limit, text).otherwise(
        F.concat(F.substring(text, 1, limit - 3), F.lit("..."))
    )


def signature(line: Column) -> Column:
    return shorten(trim_space(line), SIGNATURE_CHARS)


def display(text: Column) -> Column:
    return shorten(text, DISPLAY_CHARS)


def sanitize_map(raw: Column) -> Column:
    """Trim, drop one fence around the whole text, keep the first of each run of blank lines."""
    text = F.replace(trim_space(raw), F.lit("\r\n"), F.lit("\n"))
    last_fence = rf"\n{_IN_LINE}*```\z"
    fenced = text.rlike(r"^```[^\n]*\n") & text.rlike(last_fence)
    inner = F.regexp_replace(
        F.regexp_replace(text, r"^```[^\n]*\n", ""), rf"(?:^|\n){_IN_LINE}*```\z", ""
    )
    body = F.when(fenced, inner).otherwise(text)
    return trim_space(F.regexp_replace(body, rf"\n{_SPACE}*\n", "\n\n"))


def cap_bytes(text: Column, limit: int = MAP_BYTES, marker: str | None = None) -> Column:
    """Cut to at most ``limit`` bytes, marker included, without splitting a character."""
    marker = f"\n\n... [orientation map truncated at {limit} bytes]" if marker is None else marker
    room = max(limit - len(marker.encode()), 0)
    # A character has at most four bytes, so one of these four cuts is whole.
    cuts = [
        F.substring(text.cast("binary"), 1, max(room - back, 0)).cast("string") for back in range(4)
    ]
    kept = F.coalesce(*(F.when(F.is_valid_utf8(cut), cut) for cut in cuts))
    return F.when(F.octet_length(text) <= limit, text).otherwise(
        F.concat(trim_space_end(kept), F.lit(marker))
    )
