"""Problem 8: evaluation texts that stand, wholly or partly, in a training corpus.

Wu-Manber multi-pattern search with words as symbols. Every run of ``RUN`` words of a
test item is a pattern (of fewer words where half the item has fewer). A block of two words
looks up how far the window may move (the shift table); where it may not move, the bucket
of that suffix names the patterns, and a direct comparison confirms one. Confirmed runs that
lie on about one diagonal are then aligned word by word, so that misread words, another
spelling of accented letters, page furniture and wrapped lines don't hide a leak.

Both sides are folded first (:func:`foliospark.llm.base.fold`). One set of tables holds all
items, so the documents are read once and never shuffled. Its size is bounded in words
(``PASS_WORDS``, about 350 bytes each in a Python worker), measured before; only more items
than that, some twelve thousand of fifty words, are searched in further passes.

Null or empty items and documents give no rows. An item or document that is there twice
under two ids gives its pairs for both ids; wholly repeated rows give one row.
"""

from __future__ import annotations

from difflib import SequenceMatcher
from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.session import cut

from .base import fold_words, map_batches, require

RUN = 4
PASS_WORDS = 600_000
#: The before-part of a pattern is one number of at most two words: no run may be longer.
assert RUN <= 4
#: Share of an item's words that must stand together in the document.
MIN_SHARE = 0.5
#: Words of the document that furniture may put between two parts of one passage.
MAX_GAP = 16
#: Words of the item that may be misread beyond recognition in a row.
MAX_LOST = 4
#: A stretch counts where at least this part of its words is found in it.
MIN_DENSITY = 0.8
#: Of the words that a passage must have, the part that must be found as such.
MIN_FOUND = 0.92
#: Confirmed runs that a passage has for each of its words, at least, even if much misread.
MIN_RUNS = 0.25

PAIRS = "item_id bigint, doc_id bigint, item_words int, stretch_words int, matched_words int"


class WuManber:
    """Shift tables with suffix buckets, one for each length of patterns, over runs of words of
    all items. Words are numbered, so that a block of two is one number; a bucket holds the
    patterns by what stands before the suffix (at most two words, one number as well)."""

    def __init__(self, items: list[list[str]], runs: list[int]):
        self.numbers: dict[str, int] = {}
        self.tables: dict[int, dict] = {}
        numbered = [[self.numbers.setdefault(w, len(self.numbers)) for w in words] for words in items]
        self.base = base = len(self.numbers)
        for item, (words, run) in enumerate(zip(numbered, runs)):
            table = self.tables.setdefault(run, {})
            for i in range(len(words) - run + 1):
                pattern = words[i : i + run]
                for k in range(1, run - 1):
                    block, move = pattern[k - 1] * base + pattern[k], run - 1 - k
                    old = table.get(block)
                    if old is None or (type(old) is int and old > move):
                        table[block] = move
                suffix = pattern[-1] if run == 1 else pattern[-2] * base + pattern[-1]
                bucket = table.get(suffix)
                if type(bucket) is not dict:
                    bucket = table[suffix] = {}
                bucket.setdefault(self._before(pattern, run - 2), []).append((item, i))

    def _before(self, words: list[int], end: int) -> int:
        return -1 if end < 1 else words[0] if end == 1 else words[end - 2] * self.base + words[end - 1]

    def search(self, words: list[str]) -> dict[int, list[tuple[int, int]]]:
        """item -> [(position in the item, position in ``words``)] of confirmed runs."""
        hits: dict[int, list[tuple[int, int]]] = {}
        number = self.numbers.get
        doc = [number(w, -1) for w in words]
        base, n = self.base, len(doc)
        for run, table in self.tables.items():
            look, longest, at = table.get, run - 1, run - 1
            while at < n:
                b = doc[at]
                if b < 0:  # no pattern holds the word, so none that reaches over it can stand here
                    at += run
                    continue
                if run == 1:
                    found = look(b, 1)
                else:
                    a = doc[at - 1]
                    found = look(a * base + b, longest) if a >= 0 else longest
                if type(found) is int:
                    at += found
                    continue
                first = at - run + 1
                before = -1 if run < 3 else doc[first] if run == 3 else doc[first] * base + doc[first + 1] if doc[first] >= 0 <= doc[first + 1] else -2
                for item, i in found.get(before, ()):
                    if item in hits:
                        hits[item].append((i, first))
                    else:
                        hits[item] = [(i, first)]
                at += 1
        return hits


def _alike(a: str, b: str) -> bool:
    """Equal but for recognition errors."""
    return a == b or (abs(len(a) - len(b)) <= 2 and SequenceMatcher(None, a, b, False).ratio() >= 0.6)


def _joined(x, y) -> bool:
    """Whether two matched blocks belong to one passage: few words of the item between
    them, which may be misread or split, and no more of the document than furniture."""
    lost, put = y.a - x.a - x.size, y.b - x.b - x.size
    return lost <= MAX_LOST and put <= (lost + 3 if lost > 1 else MAX_GAP)


def _misread(item: list[str], doc: list[str], x, y) -> int:
    """Words between two blocks that are the item's but for recognition errors."""
    a, b = item[x.a + x.size : y.a], doc[x.b + x.size : y.b]
    return sum(map(_alike, a, b)) if len(a) == len(b) else 0


def _together(hits: list[tuple[int, int]], least: int) -> list[tuple[int, int]]:
    """Of the confirmed runs one for each group of at least ``least`` on about one diagonal."""
    if len(hits) < least:
        return []
    on = sorted((j - i, i, j) for i, j in hits)
    out, lo = [], 0
    for hi, (d, i, j) in enumerate(on):
        while d - on[lo][0] > MAX_GAP:
            lo += 1
        if hi - lo + 1 >= least and len({x[1] for x in on[lo : hi + 1]}) >= least:
            first = on[lo]
            if not out or first[0] - (out[-1][1] - out[-1][0]) > MAX_GAP:
                out.append(first[1:])
    return out


def stretch(item: list[str], doc: list[str], hits: list[tuple[int, int]]) -> tuple[int, int]:
    """Longest stretch of the item that stands together in ``doc`` near confirmed runs:
    (its length in words of the item, how many of them were matched)."""
    n, best, tried = len(item), (0, 0), []
    for i, j in hits:
        lo = max(0, j - i - MAX_GAP)
        if any(a <= lo <= a + MAX_GAP for a in tried):
            continue
        tried.append(lo)
        window = doc[lo : lo + n + 3 * MAX_GAP]
        blocks = [b for b in SequenceMatcher(None, item, window, False).get_matching_blocks() if b.size]
        # chains of blocks that furniture or misread words part, but no more than that
        chain: list = []
        for b in [*blocks, None]:
            if b and (not chain or _joined(chain[-1], b)):
                chain.append(b)
                continue
            if chain:
                a, c = chain[0].a, chain[0].b
                while a and c and _alike(item[a - 1], window[c - 1]):
                    a, c = a - 1, c - 1
                e, f = chain[-1].a + chain[-1].size, chain[-1].b + chain[-1].size
                while e < n and f < len(window) and _alike(item[e], window[f]):
                    e, f = e + 1, f + 1
                got = sum(x.size for x in chain) + chain[0].a - a + e - chain[-1].a - chain[-1].size
                got += sum(_misread(item, window, x, y) for x, y in zip(chain, chain[1:]))
                if got >= MIN_DENSITY * (e - a):
                    best = max(best, (e - a, got))
            chain = [b] if b else []
    return best


def leaks(items: DataFrame, docs: DataFrame, min_share: float = MIN_SHARE, pass_words: int = PASS_WORDS) -> DataFrame:
    """Pairs (item_id, doc_id) with the length of the longest shared stretch, where it has
    at least ``min_share`` of the item's words. Needs ``item_id, text`` and ``doc_id, text``."""
    spark = docs.sparkSession
    items = require(items, "item_id", "text").where("item_id is not null and text is not null")
    docs = require(docs, "doc_id", "text").where("doc_id is not null and text is not null")
    folded = map_batches(items, lambda: lambda ids, texts: [(i, " ".join(w), len(w)) for i, t in zip(ids, texts) if (w := fold_words(t))], "item_id bigint, words string, n bigint")
    folded = cut(folded)
    passes = max(1, -(-(folded.agg(F.sum("n")).first()[0] or 0) // pass_words))
    out = None
    for k in range(passes):
        part = folded.where(F.pmod(F.xxhash64("item_id", "words"), F.lit(passes)) == k) if passes > 1 else folded
        # at most about ``pass_words`` words
        shared = spark.sparkContext.broadcast([(r.item_id, r.words) for r in part.toLocalIterator()])
        found = map_batches(docs, _finder(shared, min_share), PAIRS)
        out = found if out is None else out.unionByName(found)
    best = F.max(F.struct("stretch_words", "matched_words", "item_words")).alias("b")
    return out.groupBy("item_id", "doc_id").agg(best).select("item_id", "doc_id", "b.item_words", "b.stretch_words", "b.matched_words")


def _finder(shared, min_share: float):
    def make():
        items = [(i, w.split()) for i, w in shared.value]
        searcher = WuManber([w for _, w in items], [min(RUN, max(1, ceil(len(w) * min_share))) for _, w in items])

        def run(ids, texts):
            rows = []
            for doc_id, text in zip(ids, texts):
                words = fold_words(text)
                for k, hits in searcher.search(words).items():
                    item, own = items[k]
                    near = _together(hits, max(1, int(len(own) * min_share * MIN_RUNS)))
                    if not near:
                        continue
                    length, got = stretch(own, words, near)
                    if length >= min_share * len(own) and got >= MIN_FOUND * min_share * len(own):
                        rows.append((item, doc_id, len(own), length, got))
            return rows

        return run

    return make


def leaked_items(pairs: DataFrame) -> DataFrame:
    """Per test item: in how many documents it stands, and the longest stretch."""
    return pairs.groupBy("item_id").agg(
        F.count("*").alias("documents"), F.max("stretch_words").alias("longest_stretch"), F.first("item_words").alias("item_words")
    )
