"""Character classes as regular-expression text, the same for Java and RE2."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of the Unicode standard, with the four separators below U+0020 (fixed values).
SPACE = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
PRINTABLE = r"[^\p{C}\p{Z}]|\x{20}"
BROKEN_SIGN = r"[\x{fffd}\x{e000}-\x{f8ff}]"
ALNUM_OR_SPACE = rf"[\p{{L}}\p{{N}}{SPACE}]"
#: Runs of what isn't printable, is broken, is neither letter, digit nor space, is space.
#: The signs that texts are full of come first as literals, for the engine to test cheaply.
NOT_PRINTABLE = r"(?:[\t\n\r]|[\p{C}\p{Z}&&[^\x{20}]])+"
BROKEN = r"[\x{fffd}\x{e000}-\x{f8ff}]+"
NEITHER = rf"(?:[.,;:!?'\"()-]|[^a-zA-Z0-9\p{{L}}\p{{N}}{SPACE}])+"
SPACES = rf"[{SPACE}]+"


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends (``trim`` takes U+0020 only)."""
    return F.regexp_replace(c, rf"^[{SPACE}]+|[{SPACE}]+$", "")


def occurrences(c: Column, pattern: str) -> Column:
    """Characters of ``c`` in the matches of a pattern. Matches are cut out, so a pattern of
    runs costs one step a run, and the rarer of a class and its complement costs less."""
    return F.length(c) - F.length(F.regexp_replace(c, pattern, ""))


def words(c: Column) -> Column:
    """Number of words between white space."""
    return F.regexp_count(c, F.lit(rf"[^{SPACE}]+"))
