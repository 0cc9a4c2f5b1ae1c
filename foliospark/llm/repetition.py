"""Problem 1: repetition inside a single document.

Per document the share of its words that lie in a stretch of ``STRETCH`` or more words
that occurred earlier in the same document, and the shares of repeated phrases, lines,
sentences and word pairs. Rules over these measures vote *repetitive*, vote *not*, or
abstain near their threshold. Expectation-maximisation over the counts of the vote patterns
(a few hundred at most, however many documents there are) estimates how often each rule is
right, and the posterior probability of a document's pattern decides: no single rule has to
pass, and one that errs is outvoted by those that the data show to be better.

Words are compared without case, punctuation and spacing; digits count. Null, blank and
wordless texts are left out. Pages without readable words take no part in the fit and are
no cases. Rows that repeat a text each give their own row.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.session import cut

from .base import map_batches, require
from .textstats import FEW_READABLE, readable_share

STRETCH, PHRASE = 5, 3
#: Posterior probability from which a document is repetitive.
PROBABLE = 0.5

_TOKEN = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"[.!?…]+[\"'”»)]*\s+")

MEASURES = "words int, repeated_share double, phrase_share double, line_share double, sentence_share double, pair_share double, readable boolean"

#: Rules: column, votes *repetitive* from, votes *not* up to; between them it abstains.
RULES = (
    ("repeated_share", 0.45, 0.35),
    ("phrase_share", 0.5, 0.35),
    ("line_share", 0.35, -1.0),
    ("sentence_share", 0.3, 0.05),
    ("pair_share", 0.45, 0.3),
)


def stretch_share(words: list[str], n: int = STRETCH) -> float:
    """Share of ``words`` within runs of at least ``n`` words that occurred earlier."""
    total = len(words)
    if total <= n:
        return 0.0
    runs = list(zip(*[words[k:] for k in range(n)]))
    if len(set(runs)) == len(runs):
        return 0.0
    seen, covered, upto = set(), 0, 0
    for i, run in enumerate(runs):
        if run in seen:
            covered += i + n - max(i, upto)
            upto = i + n
        else:
            seen.add(run)
    return covered / total


def _share(parts: list[str]) -> float:
    """Share of the characters in parts that occurred before."""
    if len(set(parts)) == len(parts):
        return 0.0
    seen, again = set(), 0
    for p in parts:
        if p in seen:
            again += len(p)
        seen.add(p)
    return again / sum(map(len, parts))


def measures(df: DataFrame, id_col: str = "id", text_col: str = "extracted_text") -> DataFrame:
    def make():
        known: dict = {}

        def run(ids, texts):
            rows = []
            for i, text in zip(ids, texts):
                low = text.lower()
                words = _TOKEN.findall(low)
                if not words:
                    continue
                phrases = stretch_share(words, PHRASE)
                share = stretch_share(words) if phrases else 0.0  # a repeated stretch repeats phrases
                lines = [x for x in map(str.strip, low.split("\n")) if x]
                sentences = [" ".join(x.split()) for x in _SENTENCE.split(low)]
                pairs = len(words) - 1 - len(set(zip(words, words[1:])))
                readable = readable_share(text, known) >= FEW_READABLE
                rows.append((i, len(words), share, phrases, _share(lines), _share([s for s in sentences if s]), max(0, pairs) / len(words), readable))
            return rows

        return run

    return map_batches(require(df, id_col, text_col).where(F.col(text_col).rlike(r"\S")), make, f"result_id bigint, {MEASURES}")


def votes(measured: DataFrame) -> DataFrame:
    """Adds ``pattern``: per rule 1 (repetitive), 0 (not) or - (abstains)."""
    vote = lambda c, hi, lo: F.when(F.col(c) >= hi, "1").when(F.col(c) <= lo, "0").otherwise("-")
    return measured.withColumn("pattern", F.concat(*[vote(*r) for r in RULES]))


def fit(counts: dict[str, int], rounds: int = 50, prior: float = 0.1) -> tuple[dict[str, float], list[tuple[float, float]], float]:
    """EM over vote patterns: (posterior by pattern, (true and false positive rate) by rule,
    share of repetitive documents). Deterministic; rules start as rather right."""
    if not counts:
        return {}, [(0.9, 0.1)] * len(RULES), prior
    patterns = sorted(counts)
    n = np.array([counts[p] for p in patterns], dtype=float)
    yes = np.array([[c == "1" for c in p] for p in patterns], dtype=float)
    no = np.array([[c == "0" for c in p] for p in patterns], dtype=float)
    hit, false = np.full(len(RULES), 0.9), np.full(len(RULES), 0.05)
    post = np.zeros(len(patterns))
    for _ in range(rounds):
        a = np.log(prior) + yes @ np.log(hit) + no @ np.log(1 - hit)
        b = np.log(1 - prior) + yes @ np.log(false) + no @ np.log(1 - false)
        post = 1 / (1 + np.exp(np.clip(b - a, -50, 50)))
        w1, w0 = post * n, (1 - post) * n
        # a rule is held to be better than chance, and never quite certain
        hit = np.clip((w1 @ yes + 1) / (w1 @ (yes + no) + 1.2), 0.6, 0.999)
        false = np.clip((w0 @ yes + 0.1) / (w0 @ (yes + no) + 2), 0.001, 0.4)
        prior = float(np.clip(w1.sum() / n.sum(), 1e-4, 0.5))
    return dict(zip(patterns, post.tolist())), list(zip(hit.tolist(), false.tolist())), prior


def repetition(df: DataFrame, id_col: str = "id", text_col: str = "extracted_text") -> DataFrame:
    """Measures, votes and posterior ``p_repetitive`` of every document with words; 0 for
    documents without readable words."""
    voted = votes(cut(measures(df, id_col, text_col)))  # read twice: counted, then scored
    counts = {r.pattern: r["count"] for r in voted.where("readable").groupBy("pattern").count().collect()}  # at most 3 ** rules
    posterior, _, _ = fit(counts)
    known = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in posterior.items())) if posterior else F.create_map().cast("map<string,double>")
    return voted.withColumn("p_repetitive", F.when(F.col("readable"), known[F.col("pattern")]).otherwise(F.lit(0.0)))


def repetitive(scored: DataFrame) -> DataFrame:
    """Documents whose vote pattern is probably that of repetitive ones."""
    return scored.where(F.col("p_repetitive") >= PROBABLE)
