"""Text clean-up with Unicode white space, and the stable text hash."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Unicode text treats as white space.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(map(chr, range(0x2000, 0x200B)))
    + "\u2028\u2029\u202f\u205f\u3000"
)
JSON_WHITESPACE = " \t\n\r"

# White space inside a regex (Java needs (?U) for the Unicode part of \s).
WS = r"[\s\x1c-\x1f]"


def strip(col: Column) -> Column:
    """Trim Unicode white space; plain ``trim`` removes spaces only."""
    return F.btrim(col, F.lit(WHITESPACE))


def clean(col: Column) -> Column:
    """Null becomes the empty text, everything else is stripped text."""
    return strip(F.coalesce(col.cast("string"), F.lit("")))


def text_hash(col: Column, digits: int = 8) -> Column:
    """Leading hex digits of the MD5 as a non-negative bigint (at most 15 digits).

    Stable across processes and engines, so sampling and template choice repeat.
    """
    return F.conv(F.substring(F.md5(col.cast("binary")), 1, digits), 16, 10).cast("bigint")


def words(col: Column) -> Column:
    """White-space separated tokens of a text; an empty text has none."""
    body = clean(col)
    return F.when(body == "", F.array().cast("array<string>")).otherwise(
        F.split(body, f"(?U){WS}+")
    )


def truncate_tokens(col: Column, limit: int) -> Column:
    """First ``limit`` tokens joined by one space."""
    if limit <= 0:
        raise ValueError("limit must be positive")
    return F.array_join(F.slice(words(col), 1, limit), " ")
