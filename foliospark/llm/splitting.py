"""Problem 3: items above a size limit, cut into ordered pieces at natural boundaries.

Recursive bisection: a stretch longer than the limit less the overlap is cut at the
strongest boundary near its midpoint (paragraph, sentence at a line end, sentence, line,
clause, blank), nearest first among equals; where the middle half holds none, the whole
stretch is searched, and only a stretch without any boundary is cut at its midpoint (never
before a combining mark). Then every piece but the first takes the last ``overlap``
characters before it. Without their overlaps the pieces are the text, character by character.

Sizes are code points. Null texts and texts within the limit give no pieces. An item that
is there twice under two ids is split for both. Kinds without a limit are left out.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import map_batches, require

#: Boundaries, strongest first; a cut lies at the end of a match (fixed values).
BOUNDARIES = (
    ("paragraph", re.compile(r"\n[ \t]*\n\s*")),
    ("sentence_line", re.compile(r"[.!?…][\"'”»)]*[ \t]*\n")),
    ("sentence", re.compile(r"[.!?…][\"'”»)]*\s+")),
    ("line", re.compile(r"\n")),
    ("clause", re.compile(r"[,;:—–]\s+")),
    ("blank", re.compile(r"\s+")),
)

PIECES = "item_id bigint, piece_no int, pieces int, start_char int, end_char int, overlap_chars int, boundary string"


def _cut(text: str, lo: int, hi: int) -> tuple[int, str]:
    """Where to cut ``text[lo:hi]``, strictly inside, and at what boundary."""
    mid, quarter = (lo + hi) // 2, (hi - lo) // 4
    for a, b in ((mid - quarter, mid + quarter), (lo, hi)):
        for name, form in BOUNDARIES:
            at = [m.end() for m in form.finditer(text, max(a, lo), min(b, hi)) if lo < m.end() < hi]
            if at:
                return min(at, key=lambda x: abs(x - mid)), name
    while mid < hi - 1 and unicodedata.combining(text[mid]):
        mid += 1
    return mid, "none"


def bisect(text: str, max_chars: int, overlap: int) -> list[tuple[int, int, str]]:
    """(start, end, boundary at the end) of each piece without its overlap."""
    core = max_chars - overlap
    if len(text) <= max_chars:
        return [(0, len(text), "end")]
    done, open_ = [], [(0, len(text), "end")]
    while open_:
        lo, hi, ends = open_.pop()
        if hi - lo <= core:
            done.append((lo, hi, ends))
            continue
        at, name = _cut(text, lo, hi)
        open_ += [(at, hi, ends), (lo, at, name)]
    return done


def pieces(df: DataFrame, id_col: str, text_col: str, max_chars: int, overlap: int, with_text: bool = True) -> DataFrame:
    """One row per piece of each item of more than ``max_chars`` characters."""
    if not 0 <= overlap < max_chars:
        raise ValueError(f"an overlap of {overlap} doesn't fit pieces of {max_chars}")
    large = require(df, id_col, text_col).where(F.length(text_col) > max_chars)

    def make():
        def run(ids, texts):
            rows = []
            for i, text in zip(ids, texts):
                parts = bisect(text, max_chars, overlap)
                for k, (a, b, ends) in enumerate(parts):
                    start = max(0, a - overlap)
                    rows.append((i, k + 1, len(parts), start, b, a - start, ends, *([text[start:b]] if with_text else [])))
            return rows

        return run

    return map_batches(large, make, PIECES + (", text string" if with_text else ""))


def split_all(limits: DataFrame, tables: dict[str, tuple[DataFrame, str, str]], with_text: bool = True) -> DataFrame:
    """Pieces of every table named in ``limits`` (a row per kind of item: its size is the
    number of kinds). ``tables``: kind -> (table, id column, text column)."""
    out = None
    limits = require(limits, "item_kind", "max_chars", "overlap_chars").where("max_chars is not null and overlap_chars is not null")
    for r in limits.where(F.col("item_kind").isin(*tables)).dropDuplicates(["item_kind"]).collect():
        df, id_col, text_col = tables[r.item_kind]
        part = pieces(df, id_col, text_col, r.max_chars, r.overlap_chars, with_text)
        part = part.select(F.lit(r.item_kind).alias("item_kind"), *part.columns)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return limits.sparkSession.createDataFrame([], f"item_kind string, {PIECES}" + (", text string" if with_text else ""))
    return out
