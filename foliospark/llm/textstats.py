"""Problem 2: per-document text statistics, and whether a page is prose, list, table or junk.

Words and lines are measured in one Arrow pass over the whole texts, in which each distinct
word is judged once per task (the same statistics as ``regexp_count`` expressions took
several times the CPU). Per language a mergeable KLL quantile sketch of each statistic is
built; sketches of separate partitions, days or tables merge (:func:`sketches`,
:func:`merged`). A value becomes a robust z-score against its language's median and
interquartile range, and a page is flagged where it lies in the tail: few readable words
for junk, many lines of cells for a table, many entries for a list. The tails decide the
kind: there is no fixed cut on a share, so what is usual in a language is no flag there.

Null, empty and blank texts have no statistics and no kind (they are left out). Languages
that can't be told count as ``und`` and are held against all languages together. Repeated rows each give their own row.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.session import cut

from .base import map_batches, require

#: Common words by language, for language and prose (fixed values).
COMMON = {
    "en": "the of and to in was were that this with for not by they from had it at which each some",
    "fr": "le la les des et du une dans les sur pour qui que ne plus aux ses par est avec",
    "de": "der die das und den nicht ein eine von zu mit für auf dem des im war wie aus sie",
    "es": "el los las del que por con una para sus como más ya entre desde en y al su lo",
}

#: Forms of single lines and words (fixed values).
CELLS = re.compile(
    r"\S {3,}\S|\S {2,}\S+(?: \S+)* {2,}\S|\|[^|]*\||^\s*(?:│ |[├┌└]─)|\S\t+\S|^[^;]*;[^ ;][^;]*;[^ ;]|^[^,]+,[^ ,][^,]*,[^ ,]"
)
MARKER = re.compile(r"\s*(?:[-*•▪·–◦‣o\uf0b7]|\(?[0-9]{1,3}[.)]|\(?[ivxlc]{1,6}[.)]|\(?[a-zA-Z][.)]|\[[ x]?\])\s+\S")
MARKED = re.compile(MARKER.pattern + r"|.*\S ?(?:\. ?){4,}\s*[0-9ivxlc]+\s*$|[^0-9]{2,60}(?:, [0-9]{1,4})+\s*$")
SPACED = re.compile(r"\s*\S+(?:  \S+)+\s*$")
READABLE = re.compile(
    r"(?:[^\W\d_]?(?=[^\W\d_]*[aeiouyà-ÿ])[^\W\d_A-ZÀ-Þ]+|(?=[^\W\d_]*[AEIOUYÀ-Ü])[^\W\d_a-zà-ÿ]+|[0-9]+(?:[.,][0-9]+)?)$"
)
EDGES = ".,;:!?…'’‘”“„«»()[]\"—–*/|│¿¡-‐¬\xad"
RULED = re.compile(r"[-─-╿|_=*.—–:…¶•▪·\uf0b7,;\"'«»“”]*$")
SENTENCE = re.compile(r"[.!?…][\"'”»)]*(?=\s|$)")
SYMBOLS = re.compile(r"[^\w\s.,;:!?'’\"“”„«»()–—-]|_")
DIGITS = re.compile(r"[0-9]")

#: A line of more characters is a paragraph, whatever it begins with.
LONG_LINE = 100
#: An unmarked line of at most so many words may be an entry.
SHORT_WORDS = 5

#: Statistics that are sketched.
SKETCHED = ("words", "mean_word_length", "symbol_ratio", "digit_ratio", "sentence_end_share", "common_share", "readable_share", "cell_share", "entry_share")

#: A scale below this counts as this: a share whose quartiles coincide has no spread of its own.
SCALE_FLOOR = 0.1
#: Robust z-scores from which lines lie in the tail, and below which readable words do.
TAIL, LOW_TAIL = 4.0, -6.0
#: Cells beside entries from which a page with both is a table, as a ratio of their z-scores.
CELLS_WEIGH = 0.7
#: Share of readable words below which a text holds none to speak of (asked by other problems).
FEW_READABLE = 0.34
#: Sentence ends per line, below which short lines aren't wrapped prose.
FEW_SENTENCES = 0.2


#: The languages in which a word is common, by position.
_LANGS = tuple(COMMON)
_COMMON = {w: tuple(k for k, lang in enumerate(_LANGS) if w in COMMON[lang].split()) for lang in COMMON for w in COMMON[lang].split()}
_MEMORY = 400_000


def _word(word: str) -> tuple[int, int, tuple[int, ...]]:
    """(characters, readable characters, languages in which it is common). Rules and leader
    dots don't count at all, other signs without a word count as unreadable."""
    core = word.strip(EDGES)
    if not core:
        return (0 if RULED.match(word) else len(word)), 0, ()
    parts = [x for x in re.split("[-'’‐—/;,|]", core) if x]
    return len(word), len(word) * all(map(READABLE.match, parts)), _COMMON.get(core.lower(), ())


def readable_share(text: str, known: dict[str, tuple]) -> float:
    """Share of the characters of words that can be read; the same as :func:`measure` gives."""
    tokens = readable = 0
    for w in text.split():
        got = known.get(w)
        if got is None:
            if len(known) > _MEMORY:
                known.clear()
            got = known[w] = _word(w)
        tokens += got[0]
        readable += got[1]
    return readable / tokens if tokens else 0.0


def measure(text: str, known: dict[str, tuple]) -> tuple:
    """The statistics of one non-blank text, in the order of ``STATS``. ``known`` remembers words."""
    words = text.split()
    tokens = readable = 0
    common = [0] * len(_LANGS)
    for w in words:
        got = known.get(w)
        if got is None:
            if len(known) > _MEMORY:
                known.clear()
            got = known[w] = _word(w)
        tokens += got[0]
        readable += got[1]
        for k in got[2]:
            common[k] += 1
    lines = cells = marked = short = ends = 0
    ink = cell_ink = marked_ink = short_ink = 0
    for line in text.split("\n"):
        core = line.strip()
        if not core:
            continue
        n = len(core)
        lines += 1
        ink += n
        ends += core.rstrip("\"'”»)]")[-1:] in (".", "!", "?", ":", ";", "…")
        if CELLS.search(line) and (n <= LONG_LINE or core[0] in "|│├┌└" or "   " in core or "\t" in core) and not SPACED.match(line):
            cells += 1
            cell_ink += n
        elif n > LONG_LINE:
            continue
        elif MARKED.match(line):
            marked += 1
            marked_ink += n
        elif core[-1] not in ".!?;:…" and len(core.split()) <= SHORT_WORDS:
            short += 1
            short_ink += n
    chars = len(text)
    most = max(common)
    # an unmarked short line is an entry, unless the page is narrow prose with sentences
    if short and len(SENTENCE.findall(text)) >= FEW_SENTENCES * lines:
        short = short_ink = 0
    # lines and characters must both say so: a paragraph on one line weighs as much as its text
    return (
        _LANGS[common.index(most)] if most else "und",
        chars,
        len(words),
        lines,
        sum(map(len, words)) / len(words),
        len(SYMBOLS.findall(text)) / chars,
        len(DIGITS.findall(text)) / chars,
        ends / lines,
        most / len(words),
        readable / tokens if tokens else 0.0,
        min(cells / lines, cell_ink / ink),
        min((marked + short) / lines, (marked_ink + short_ink) / ink),
    )


STATS = (
    "lang string, chars int, words int, lines int, mean_word_length double, symbol_ratio double, digit_ratio double, "
    "sentence_end_share double, common_share double, readable_share double, cell_share double, entry_share double"
)


def statistics(df: DataFrame, id_col: str = "id", text_col: str = "extracted_text") -> DataFrame:
    """``result_id``, ``lang`` and one column for each statistic; all shares lie in 0..1."""
    pages = require(df, id_col, text_col).where(F.col(text_col).rlike(r"\S"))

    def make():
        known: dict[str, tuple] = {}

        def run(ids, texts):
            return [(i, *measure(t, known)) for i, t in zip(ids, texts) if not t.isspace()]

        return run

    return map_batches(pages, make, "result_id bigint, " + STATS)


def sketches(stats: DataFrame, *keys: str) -> DataFrame:
    """One KLL sketch per statistic and group: a partial result that can be stored."""
    return stats.groupBy("lang", *keys).agg(F.count("*").alias("rows"), *[F.kll_sketch_agg_double(F.col(c).cast("double")).alias(c) for c in SKETCHED])


def merged(partial: DataFrame, *keys: str) -> DataFrame:
    """Sketches of several partitions or days combined into those of the whole."""
    return partial.groupBy("lang", *keys).agg(F.sum("rows").alias("rows"), *[F.kll_merge_agg_double(c).alias(c) for c in SKETCHED])


def quartiles(sketched: DataFrame) -> DataFrame:
    q = lambda c, p: F.kll_sketch_get_quantile_double(c, F.lit(p))
    return sketched.select("lang", *[F.array(*[q(c, p) for p in (0.25, 0.5, 0.75)]).alias(f"_q_{c}") for c in SKETCHED])


def scored(stats: DataFrame, spread: DataFrame) -> DataFrame:
    """Adds ``z_<statistic>``. ``spread`` has a row per language, so it is broadcast."""
    z = lambda c: ((F.col(c) - F.col(f"_q_{c}")[1]) / F.greatest((F.col(f"_q_{c}")[2] - F.col(f"_q_{c}")[0]) / 1.349, F.lit(SCALE_FLOOR))).alias(f"z_{c}")
    joined = stats.join(F.broadcast(spread), "lang", "left")
    return joined.select(*stats.columns, *[z(c) for c in SKETCHED])


def kinds(scores: DataFrame) -> DataFrame:
    """Adds ``kind``, from the tails alone: hardly a readable word, else the stronger of cells
    and entries."""
    c = F.col
    junk = c("z_readable_share") < LOW_TAIL
    table = (c("z_cell_share") >= TAIL) & (c("z_cell_share") >= CELLS_WEIGH * c("z_entry_share"))
    listed = c("z_entry_share") >= TAIL
    return scores.withColumn("kind", F.when(junk, "junk").when(table, "table").when(listed, "list").otherwise("prose"))


def page_kinds(df: DataFrame, id_col: str = "id", text_col: str = "extracted_text") -> DataFrame:
    """Statistics, robust z-scores and kind of every page with text."""
    stats = cut(statistics(df, id_col, text_col))  # read twice: by the sketches and by the scores
    by_lang = sketches(stats)
    whole = merged(by_lang.withColumn("lang", F.lit("und")))
    spread = quartiles(by_lang.where("lang <> 'und'").unionByName(whole))
    return kinds(scored(stats, spread))
