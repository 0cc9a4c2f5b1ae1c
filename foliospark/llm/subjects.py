"""Problem 10: the subjects that a document treats, none, one or more.

Terms are curated by rule from hand labels: a word belongs to a subject where the log-odds
of meeting it inside and outside the labelled documents of that subject reach ``MIN_ODDS``.
A multi-pattern automaton (Aho-Corasick) finds all terms of all subjects in one pass over
each folded text. A term weighs its log-odds, less where it is frequent in the corpus; a
sentence is about a subject where the weights of its terms reach ``MIN_WEIGHT``; a document
gets every subject whose share of its sentences reaches that subject's threshold, which is
calibrated on the labelled documents around ``SHARE``.

Only the labelled rows are a bounded sample (``MAX_LABELLED`` documents, lowest hash
first); term rarity and the subjects themselves come from all documents. Every word of the
sample that reaches ``MIN_ODDS`` on ``MIN_DOCUMENTS`` is a term, so the terms sent to
executors are bounded by the sample's words.

Null, empty and wordless texts have no subject. Repeated texts under other ids are
documents of their own. Without labels nothing is assigned.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.session import cut

from .base import _WORD, fold, map_batches, require

MAX_LABELLED = 20_000
MIN_ODDS = 2.5
MIN_WEIGHT = 2.5
MIN_DOCUMENTS = 3
SHARE = 0.2
#: Thresholds tried in the calibration.
GRID = (0.16, 0.17, 0.18, 0.19, 0.2, 0.21, 0.22)
#: Share of all documents from which on a term weighs less.
COMMON_TERM = 0.05

#: The s at the end of a word of five letters or more.
_PLURAL = re.compile(r"(?<=[a-z0-9]{4})s(?![a-z0-9])")
_SENTENCE = re.compile(r"(?<=[.!?])[\"”’»)]*\s+|\n\s*\n")


def sentences(text: str) -> list[list[str]]:
    """Folded words of each sentence of at least three words; a plural s is dropped."""
    out = []
    # folded as a whole: the mark between sentences passes unchanged
    for s in _PLURAL.sub("", fold("\0".join(_SENTENCE.split(text)))).split("\0"):
        words = _WORD.findall(s)
        if len(words) >= 3:
            out.append(words)
    return out


def learn_terms(docs: DataFrame, labels: DataFrame, none: str = "none") -> dict[str, dict[str, float]]:
    """term -> subject -> log-odds, from a bounded sample of labelled documents."""
    own = require(labels, "doc_id", "subject").where("doc_id is not null and subject is not null")
    own = own.groupBy("doc_id").agg(F.collect_set("subject").alias("subjects")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)
    both = require(docs, "doc_id", "text").where("text is not null").join(F.broadcast(own), "doc_id")
    words = map_batches(
        both.select("subjects", "text"),
        lambda: lambda subjects, texts: [(s, sorted({w for x in sentences(t) for w in x})) for s, t in zip(subjects, texts)],
        "subjects array<string>, words array<string>",
    )
    words = cut(words)
    whole = ""  # stands for all documents
    size = {r.subject: r.n for r in words.select(F.explode(F.array_append("subjects", F.lit(whole))).alias("subject")).groupBy("subject").agg(F.count("*").alias("n")).collect()}
    total = size.pop(whole, 0)
    size.pop(none, None)
    if not size or not total:
        return {}
    by_word = words.select(F.explode("words").alias("word"), "subjects").groupBy("word").agg(
        F.count("*").alias("n"), F.array(*[F.struct(F.lit(s).alias("subject"), F.lit(float(n)).alias("of"), F.count_if(F.array_contains("subjects", s)).alias("c")) for s, n in size.items()]).alias("by")
    )
    each = by_word.select("word", "n", F.explode("by").alias("b")).select("word", "n", "b.*").where(F.col("c") >= MIN_DOCUMENTS)
    odds = F.log((F.col("c") / F.col("of")) / ((F.col("n") - F.col("c") + 0.5) / (F.lit(float(total + 1)) - F.col("of"))))
    terms: dict[str, dict[str, float]] = {}
    for r in each.select("word", "subject", odds.alias("odds")).where(F.col("odds") >= MIN_ODDS).orderBy("word", "subject").collect():
        terms.setdefault(r.word, {})[r.subject] = r.odds
    return terms


def find_terms(docs: DataFrame, terms: list[str]) -> DataFrame:
    """``doc_id, sentences, hits``: per document the (sentence, term) pairs, once each."""

    def make():
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for k, t in enumerate(terms):
            automaton.add_word(f" {t} ", k)
        automaton.make_automaton()

        def run(ids, texts):
            rows = []
            for i, text in zip(ids, texts):
                parts = [f" {' '.join(words)} " for words in sentences(text)]
                if not parts:
                    continue
                starts, at = [], 0
                for p in parts:
                    starts.append(at)
                    at += len(p)
                found = automaton.iter("".join(parts)) if terms else ()
                hits = {(bisect_right(starts, end) - 1, k) for end, k in found}
                rows.append((i, len(parts), [{"s": s, "t": t} for s, t in sorted(hits)]))
            return rows

        return run

    pages = require(docs, "doc_id", "text").where("doc_id is not null and text is not null")
    return map_batches(pages, make, "doc_id bigint, sentences int, hits array<struct<s: int, t: int>>")


def shares(hits: DataFrame, weights: list[dict[str, float]]) -> DataFrame:
    """``doc_id, subject, share`` of the sentences that are about it."""

    def make():
        def run(ids, counts, found):
            rows = []
            for i, n, own in zip(ids, counts, found):
                by: dict[tuple[int, str], float] = {}
                for h in own or ():
                    for s, w in weights[h["t"]].items():
                        by[h["s"], s] = by.get((h["s"], s), 0.0) + w
                about: dict[str, int] = {}
                for (_, s), w in by.items():
                    if w >= MIN_WEIGHT:
                        about[s] = about.get(s, 0) + 1
                rows += [(i, s, c / n) for s, c in sorted(about.items())]
            return rows

        return run

    return map_batches(hits, make, "doc_id bigint, subject string, share double")


def calibrate(labelled: DataFrame, scored: DataFrame, subjects: list[str]) -> dict[str, float]:
    """The threshold of each subject with the best F1 on labelled documents (counted in the
    cluster: one row for each subject and grid value), nearest ``SHARE`` among equals."""
    grid = F.explode(F.array(*[F.lit(g) for g in GRID])).alias("g")
    own = require(labelled, "doc_id", "subject").distinct()
    marked = own.select("doc_id").distinct().withColumn("known", F.lit(1))
    pairs = scored.join(F.broadcast(marked), "doc_id").join(F.broadcast(own.withColumn("right", F.lit(1))), ["doc_id", "subject"], "left")
    counts = pairs.select("subject", "share", "right", grid).where("share >= g").groupBy("subject", "g").agg(F.count("*").alias("got"), F.count("right").alias("tp")).collect()
    want = {r.subject: r.n for r in own.groupBy("subject").agg(F.count("*").alias("n")).collect()}
    best = dict.fromkeys(subjects, (-1.0, SHARE))
    for r in sorted(counts, key=lambda r: (abs(r.g - SHARE), r.g)):
        if r.subject in best:
            f1 = 2 * r.tp / max(1, r.got + want.get(r.subject, 0))
            if f1 > best[r.subject][0] + 1e-9:
                best[r.subject] = (f1, r.g)
    return {s: g for s, (_, g) in best.items()}


def assign(docs: DataFrame, labels: DataFrame, none: str = "none") -> DataFrame:
    """``doc_id, subject, share`` of every subject above its threshold."""
    learned = learn_terms(docs, labels, none)
    terms = sorted(learned)
    hits = cut(find_terms(docs, terms))  # read three times, and much smaller than the texts
    each = F.array_append(F.array_distinct(F.transform("hits", lambda h: h["t"])), F.lit(-1))  # -1 stands for the document
    seen = {r.t: r.n for r in hits.select(F.explode(each).alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect()}
    total = max(1, seen.pop(-1, 0))
    rarity = lambda k: min(1.0, math.log(total / (seen.get(k, 0) + 1) + 1) / math.log(1 / COMMON_TERM + 1))
    # a term that is everywhere weighs half of what a rare one does
    weights = [{s: o * (1 + rarity(k)) / 2 for s, o in learned[t].items()} for k, t in enumerate(terms)]
    scored = shares(hits, weights)
    bounded = require(labels, "doc_id", "subject").join(
        F.broadcast(require(labels, "doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)), "doc_id", "left_semi"
    )
    # only the labelled documents are scored for the thresholds
    marked = F.broadcast(bounded.select("doc_id").distinct())
    limits = calibrate(bounded, shares(hits.join(marked, "doc_id", "left_semi"), weights), sorted({s for x in learned.values() for s in x}))
    limit = F.lit(SHARE)
    for s, g in limits.items():
        limit = F.when(F.col("subject") == s, F.lit(g)).otherwise(limit)
    return scored.where(F.col("share") >= limit - 1e-9)


def makeup(docs: DataFrame, assigned: DataFrame) -> DataFrame:
    """The corpus by subject: documents and characters; documents of several subjects count
    for each, those of none as ``none``."""
    sized = require(docs, "doc_id", "text").select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("chars"))
    both = sized.join(assigned.select("doc_id", "subject"), "doc_id", "left")
    return both.groupBy(F.coalesce("subject", F.lit("none")).alias("subject")).agg(F.count("*").alias("documents"), F.sum("chars").alias("characters"))
