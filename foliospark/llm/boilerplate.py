"""Problem 6: lines that return on page after page of one source, found and removed.

PrefixSpan, distributed. Every page becomes its sequence of line identifiers (hashes of the
lines' forms), kept as a table. The first level counts, per source, on how many distinct
pages each identifier stands; one is frequent from ``MIN_PAGES`` pages and ``MIN_SHARE`` of
the source's pages with text. Longer sequences grow level by level from the places where
the frequent ones end - the projected database - by the next frequent line of the page,
until a level has none. Lines that aren't frequent are passed over; frequent ones may not
be, so a page of k frequent lines gives at most k candidates a level. What comes out are the
closed sequences: those that no longer one holds on as many pages. Every frequent line is
part of one, so the lines to remove are those of the sequences.

Counting first groups by source, line and page, then by source and line: the first
exchange spreads even a line that stands on every page of one huge source, and the second
gets partial counts only. No group is ever held in one task. Exchanges hold identifiers,
not lines (128 bits: two hashes of 64); the lines themselves are read once more, from one
page for each frequent line.

Rows without source or page number, null and blank texts don't count. A page that was
saved again counts once. A source is compared by its id, lines by their form.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.session import cut, keep

from .base import require

MIN_PAGES = 8
MIN_SHARE = 0.2
#: Rows (one a frequent line, at most some hundred bytes) up to which a table is broadcast.
BROADCAST_ROWS = 200_000

#: Letters of the form of a line (fixed values).
LETTERS = "a-zà-öø-ÿœ"


def form(text: Column) -> Column:
    """Form in which lines are compared; line feeds stay."""
    t = F.regexp_replace(F.lower(text), "[0-9]+", "#")
    return F.regexp_replace(t, rf"[^{LETTERS}#\n]+", " ")


def _pages(df: DataFrame, source: str, page: str, text: str) -> DataFrame:
    p = require(df, source, page, text).where(F.col(source).isNotNull() & F.col(page).isNotNull() & F.col(text).rlike(r"[^\s\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{3000}]"))
    return p.select(F.col(source).cast("bigint").alias("source"), F.col(page).cast("bigint").alias("page"), F.col(text).alias("text"))


def _small(df: DataFrame) -> DataFrame:
    """A cut table with a broadcast hint where it has few rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _lines(pages: DataFrame) -> DataFrame:
    """``source, page, copy, at, line`` of the lines with a letter; ``copy`` tells the texts of
    one page apart."""
    placed = pages.select("source", "page", F.xxhash64("text").alias("copy"), F.posexplode(F.split(form(F.col("text")), "\n")).alias("at", "line"))
    return placed.withColumn("line", F.trim("line")).where(F.col("line").rlike(f"[{LETTERS}]"))


def _identified(pages: DataFrame) -> DataFrame:
    """The database of sequences: ``source, page, copy, at, h, g``. A row with ``at`` -1 stands
    for the page itself, so that pages without such lines count as well."""
    text = pages.select("source", "page", F.xxhash64("text").alias("copy"), F.split(form(F.col("text")), "\n").alias("forms"))
    ids = F.transform("forms", lambda x, k: F.struct(k.alias("at"), F.xxhash64(F.trim(x)).alias("h"), F.xxhash64(F.trim(x), F.lit(7)).alias("g"), x.rlike(f"[{LETTERS}]").alias("letters")))
    own = F.array(F.struct(F.lit(-1).alias("at"), F.lit(0).cast("bigint").alias("h"), F.lit(0).cast("bigint").alias("g"), F.lit(True).alias("letters")))
    return text.select("source", "page", "copy", F.explode(F.concat(own, ids)).alias("x")).where("x.letters").select("source", "page", "copy", "x.at", "x.h", "x.g")


def _first_level(lines: DataFrame, min_pages: int, min_share: float) -> DataFrame:
    """``source, h, g, pages, of_pages, page, at``: the frequent lines, with a place of each."""
    support = (
        lines.groupBy("source", "h", "g", "page").agg(F.min("at").alias("at"))
        .groupBy("source", "h", "g").agg(F.count("*").alias("pages"), F.min(F.struct("page", "at")).alias("place"))
        .where(F.col("pages") >= min_pages)
    )
    # the pages of a source are counted like a line that stands on each of them
    of = support.where("h = 0 and g = 0 and place.at = -1").select("source", F.col("pages").alias("of_pages"))
    own = support.where("not (h = 0 and g = 0 and place.at = -1)").join(of, "source").where(F.col("pages") >= min_share * F.col("of_pages"))
    return own.select("source", "h", "g", "pages", "of_pages", "place.page", "place.at")


def _named(first: DataFrame, pages: DataFrame) -> DataFrame:
    """Adds ``line``, read from the place of each frequent line."""
    places = first.select("source", "page").distinct()
    lines = _lines(pages.join(_small(places), ["source", "page"], "left_semi"))
    lines = lines.select("source", F.xxhash64("line").alias("h"), F.xxhash64("line", F.lit(7)).alias("g"), "line")
    return lines.join(_small(first), ["source", "h", "g"]).dropDuplicates(["source", "h", "g"]).select("source", "h", "line", "pages", "of_pages")


def frequent_lines(df: DataFrame, source: str = "job_id", page: str = "page_number", text: str = "extracted_text", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """First level: ``source, line, pages, of_pages``."""
    pages = _pages(df, source, page, text)
    first = cut(_first_level(_identified(pages), min_pages, min_share))
    return _named(first, pages).drop("h")


def sequences(df: DataFrame, source: str = "job_id", page: str = "page_number", text: str = "extracted_text", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """Every closed frequent sequence of lines: ``source, lines, length, pages``."""
    pages = _pages(df, source, page, text)
    lines = keep(_identified(pages))
    first = cut(_first_level(lines, min_pages, min_share))
    # each page's frequent lines in order, once for every place at which a sequence can begin
    near = lines.where("at >= 0").join(_small(first.select("source", "h", "g")), ["source", "h", "g"], "left_semi")
    rows = near.groupBy("source", "page", "copy").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "h"))), lambda x: x["h"]).alias("ids"))
    rows = rows.where(F.size("ids") > 1)
    open_ = cut(rows.select("source", "page", "ids", F.explode(F.sequence(F.lit(1), F.size("ids"))).alias("k")))
    need = first.groupBy("source").agg(F.greatest(F.lit(min_pages), F.ceil(F.lit(min_share) * F.first("of_pages"))).alias("need"))
    need = _small(cut(need))
    found = first.select("source", F.array("h").alias("ids"), "pages")
    level, longer = found, None
    for n in itertools.count(2):
        grown = open_.where(F.col("k") + (n - 1) <= F.size("ids")).withColumn("grown", F.slice("ids", F.col("k"), F.lit(n)))
        support = (
            grown.groupBy("source", "grown", "page").agg(F.lit(1).alias("one"))
            .groupBy("source", "grown").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages)
            .join(need, "source").where("pages >= need")
        )
        support = cut(support.select("source", F.col("grown").alias("ids"), "pages"))
        if support.isEmpty():
            break
        # what a longer sequence holds on as many pages isn't closed
        parts = F.explode(F.array(F.slice("ids", 1, n - 1), F.slice("ids", 2, n - 1)))
        closed = level.join(support.select("source", "pages", parts.alias("ids")).distinct(), ["source", "ids", "pages"], "left_anti")
        longer = closed if longer is None else longer.unionByName(closed)
        level = support
        open_ = cut(grown.join(_small(support.select("source", F.col("ids").alias("grown"))), ["source", "grown"], "left_semi").drop("grown"))
    found = level if longer is None else longer.unionByName(level)
    names = cut(_named(first, pages)).select("source", "h", "line")
    spelled = found.select("source", "ids", "pages", F.posexplode("ids").alias("k", "h")).join(_small(names), ["source", "h"])
    spelled = spelled.groupBy("source", "ids", "pages").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]).alias("lines"))
    return spelled.select("source", "lines", F.size("lines").alias("length"), "pages")


def lines_of(found: DataFrame) -> DataFrame:
    """``source, line``: the lines of all sequences, each once."""
    return found.select("source", F.explode("lines").alias("line")).distinct()


def cleaned(df: DataFrame, found: DataFrame, id_col: str = "id", source: str = "job_id", text: str = "extracted_text") -> DataFrame:
    """``id, source, cleaned_text, removed_lines``: every row's text without the occurrences of
    its source's sequences, single lines included. A source has at most ``lines per page /
    MIN_SHARE`` of those, so they travel as one array; up to ``BROADCAST_ROWS`` lines the
    arrays are broadcast and no text moves, beyond that the skew join of adaptive execution
    splits a huge source."""
    pages = require(df, id_col, source, text).select(F.col(id_col).alias("id"), F.col(source).alias("source"), F.col(text).alias("text"))
    frequent = cut(lines_of(found))
    per = frequent.groupBy("source").agg(F.collect_list("line").alias("_lines"))
    both = pages.join(F.broadcast(per) if frequent.count() <= BROADCAST_ROWS else per, "source", "left")
    lines = F.split(F.col("text"), "\n", -1)
    # forms are made once for the whole text; a line and its form stand at the same place
    placed = F.arrays_zip(lines.alias("line"), F.split(form(F.col("text")), "\n", -1).alias("form"))
    kept = F.transform(F.filter(placed, lambda x: ~F.array_contains(F.col("_lines"), F.trim(x["form"]))), lambda x: x["line"])
    return both.select(
        "id",
        "source",
        F.when(F.col("_lines").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("cleaned_text"),
        F.when(F.col("_lines").isNull() | F.col("text").isNull(), F.lit(0)).otherwise(F.size(lines) - F.size(kept)).cast(T.IntegerType()).alias("removed_lines"),
    )
