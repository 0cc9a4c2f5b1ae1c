"""Shared plumbing of the training-data operators: folding, words, column selection."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.arrow import map_batches  # noqa: F401 - the operators take it from here

#: Characters that break a word in two at the end of a line (fixed values).
BREAK_MARKS = "-­‐¬"


_FOLDS = str.maketrans({"ß": "ss", "œ": "oe", "æ": "ae", "ø": "o", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "­": None})
_BROKEN = re.compile(rf"(?<=[^\W\d_])[{BREAK_MARKS}][ \t]*\n\s*(?=[^\W\d_])")
_ACCENT, _OTHER = re.compile("[\u0300-\u036f]+"), re.compile(r"[^\x00-\x7f]")
_WORD = re.compile(r"[a-z0-9]+")


def fold(text: str) -> str:
    """Lower case without accents, ligatures and line-end hyphenation. Umlauts spelled
    with a following ``e`` fold to the plain letter, like the umlauts themselves."""
    t = _BROKEN.sub("", text).lower()
    if not t.isascii():
        # accents go; signs outside ASCII part words instead of gluing them together
        t = _OTHER.sub(" ", _ACCENT.sub("", unicodedata.normalize("NFKD", t.translate(_FOLDS))))
    return t.replace("ae", "a").replace("oe", "o").replace("ue", "u")


def fold_words(text: str) -> list[str]:
    return _WORD.findall(fold(text))


def require(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, whatever else (and however named) the table carries: of columns
    that differ in case only, the one that is named exactly, else the first."""
    have = df.columns
    if len({c.lower() for c in have}) == len(have):
        return df.select(*[F.col(f"`{n}`") for n in names])
    plain = df.toDF(*[f"c{i}" for i in range(len(have))])
    place = lambda n: have.index(n) if n in have else [c.lower() for c in have].index(n.lower())
    return plain.select(*[F.col(f"c{place(n)}").alias(n) for n in names])
