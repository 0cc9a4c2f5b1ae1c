"""Problem 4: noise in text from scanned pages - found, and repaired into paragraphs.

A character editor, an averaged perceptron, predicts for each character of a word keep,
replace, delete or insert, and for each mark at a line end whether the lines join there. A
second perceptron tells page furniture - running heads and page numbers alike - from text
by features of a page's first and last lines: their form, their place, the lines beside
them, how often the job's pages show the same line or the same distance between printed
number and page, and whether they are like a title. All learn from pages whose right
paragraphs are known (``gold``): noisy words are aligned with the right ones, and first or
last lines that the right text lacks are furniture. Rows of lists and tables and their own
headings, which stand on no such page, are added as text.

Texts are read in Arrow passes; only first and last lines (and counts) meet the titles of
their job. For :func:`repair` the lines to drop go to the pages as one small row a page,
broadcast up to ``BROADCAST_ROWS``. The models are fitted on at most ``MAX_GOLD`` pages; they
and the distinct words of all right paragraphs are what is sent to the executors.

Null and blank texts and rows without job or page have no noise. A page that stands twice
in a table is one case. Wrongly decoded words are left alone.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from difflib import SequenceMatcher
from functools import cached_property, lru_cache
from itertools import repeat

from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.session import cut

from .base import BREAK_MARKS, map_batches, require
from .encoding import mark_cost
from .textstats import CELLS, FEW_READABLE, MARKED, MARKER, readable_share

MAX_GOLD = 3000
#: Pages with known paragraphs on which a word must stand to count as known without them.
OFTEN = 5
#: Characters from which a line is a paragraph and isn't looked at for cells or marks.
LONG_LINE = 160
#: Characters of the beginnings and ends of known words that are remembered.
AFFIX = 5
EPOCHS, LINE_EPOCHS = 4, 20
#: Misread words from which a page counts as misread.
MIN_MISREAD = 3
#: Share of a page's words that must be known for its unknown words to be misread ones.
MIN_KNOWN = 0.35
#: Pages with furniture up to which their rows are broadcast (about 40 bytes each).
BROADCAST_ROWS = 1_000_000
#: Rows of titles and returning lines (below 200 bytes each) up to which they are broadcast.
SMALL_ROWS = 200_000

EDGE = ".,;:!?…'’‘”“„«»()[]\"—–*/|│¿¡ "
NUMBER = r"(?:\d+|(?=[ivxlc])c{0,3}(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3}))"
#: Forms of a printed page number, alone or in the line of a running head (fixed values).
NUMBER_LINE = re.compile(rf"^\s*(?:[-—–\[(]\s*)?(?:(?:page|p\.|seite|s\.|página|pág\.|pagina|folio|f\.)\s*)?{NUMBER}\s*(?:[-—–\])]|\.)?\s*$", re.I)
NUMBER_BEFORE = re.compile(rf"^\s*[\[(—–-]?\s*(?:page |seite |página |p\. )?{NUMBER}\s*[\])—–.-]?(?:\s{{2,}}|\t)(?=\S)", re.I)
NUMBER_AFTER = re.compile(rf"(?<=\S)(?:\s{{2,}}|\t)[\[(—–-]?\s*(?:page |seite |página |p\. )?{NUMBER}\s*[\])—–.-]?\s*$", re.I)
YEAR_END = re.compile(r"^\s*\d{4}\.\s*$")
VALUE = re.compile(rf"(?<![^\W_]){NUMBER}(?![^\W_])", re.I)
SENTENCE_END = ".!?:;”\"…)|│"
ROMANS = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}
PREFIX = re.compile(r"^\s*[^\W\d_]{2,9}\.?\s+(?:[ivxlc]+|\d+)\s*[.:]\s+", re.I)
BREAK = re.compile(rf"([^\W\d_]+)([{BREAK_MARKS}])[ \t]*\n\s*([^\W\d_]+)")
#: The same from its mark on, without a try at every letter of the text.
MARK_BREAK = re.compile(rf"([{BREAK_MARKS}])[ \t]*\n\s*([^\W\d_]+)")
LETTERS = re.compile(r"[^\W\d_]")
ROMAN = re.compile(r"[ivxlc]+$")


class Perceptron:
    """Averaged perceptron over string features, labels limited by ``allowed``."""

    def __init__(self):
        self.weights: dict[str, dict[str, float]] = {}
        self._sums: dict[tuple[str, str], float] = defaultdict(float)
        self._stamp: dict[tuple[str, str], int] = defaultdict(int)
        self.steps = 0

    def best(self, features: list[str], allowed: list[str]) -> tuple[str, float]:
        """(best label, how far it is ahead of the first of ``allowed``)."""
        scores = dict.fromkeys(allowed, 0.0)
        for f in features:
            own = self.weights.get(f)
            if own:
                for label, w in own.items():
                    if label in scores:
                        scores[label] += w
        top = max(allowed, key=scores.__getitem__)
        return top, scores[top] - scores[allowed[0]]

    def learn(self, features: list[str], allowed: list[str], right: str) -> None:
        self.steps += 1
        got, _ = self.best(features, allowed)
        if got != right:
            for f in features:
                self._add(f, right, 1.0)
                self._add(f, got, -1.0)

    def _add(self, f: str, label: str, by: float) -> None:
        key, own = (f, label), self.weights.setdefault(f, {})
        w = own.get(label, 0.0)
        self._sums[key] += (self.steps - self._stamp[key]) * w
        self._stamp[key] = self.steps
        own[label] = w + by

    def average(self) -> None:
        for f, own in self.weights.items():
            for label in own:
                key = (f, label)
                total = self._sums[key] + (self.steps - self._stamp[key]) * own[label]
                own[label] = total / max(1, self.steps)
        self._sums.clear()
        self._stamp.clear()


class YesNo:
    """Averaged perceptron of two labels: one weight a feature, its sign decides; no on a tie."""

    def __init__(self):
        self.weights: dict[str, float] = {}
        self._sums: dict[str, float] = defaultdict(float)
        self._stamp: dict[str, int] = {}
        self.steps = 0

    def says(self, features: list[str]) -> bool:
        return sum(map(self.weights.get, features, repeat(0.0))) > 0

    def learn(self, features: list[str], right: bool) -> None:
        self.steps += 1
        if self.says(features) != right:
            by = 1.0 if right else -1.0
            for f in features:
                w = self.weights.get(f, 0.0)
                self._sums[f] += (self.steps - self._stamp.get(f, 0)) * w
                self._stamp[f] = self.steps
                self.weights[f] = w + by

    def average(self) -> None:
        for f, w in self.weights.items():
            self.weights[f] = (self._sums[f] + (self.steps - self._stamp.get(f, 0)) * w) / max(1, self.steps)
        self._sums.clear()
        self._stamp.clear()


KEEP, DROP = "=", "-"


def edits(noisy: str, right: str) -> list[str] | None:
    """One operation for each noisy character: keep, drop, or the one to three characters
    that stand in its place (a replacement, with those inserted after it)."""
    ops = []
    for tag, a, b, c, d in SequenceMatcher(None, noisy, right, False).get_opcodes():
        if tag == "equal":
            ops += [KEEP] * (b - a)
        elif tag == "delete":
            ops += [DROP] * (b - a)
        elif tag == "insert":
            if not ops:
                return None
            last = ops[-1]
            ops[-1] = (noisy[a - 1] if last == KEEP else "" if last == DROP else last) + right[c:d]
        else:
            n, m = b - a, d - c
            if n >= m:
                ops += [right[c + k] if k < m else DROP for k in range(n)]
            else:
                ops += [right[c + k] for k in range(n - 1)] + [right[c + n - 1 : d]]
    return None if any(len(o) > 3 for o in ops) else ops


def _char_features(w: str, i: int, before: str) -> list[str]:
    p = f"^^^{w}$$$"
    k = i + 3
    c = p[k]
    return [
        f"0{c}",
        f"1{p[k - 1 : k + 1]}",
        f"2{p[k : k + 2]}",
        f"3{p[k - 2 : k + 1]}",
        f"4{p[k : k + 3]}",
        f"5{p[k - 1 : k + 2]}",
        f"6{p[k - 2 : k + 2]}",
        f"7{p[k - 1 : k + 3]}",
        f"8{p[k - 2 : k + 3]}",
        f"9{p[k - 3 : k + 4]}",
        f"b{before}{c}",
    ]


class Editor:
    """The character editor with the words known to be right."""

    def __init__(self, known: set[str]):
        self.known, self.chars, self.joins = known, Perceptron(), Perceptron()
        self.options: dict[str, list[str]] = {}
        self.pairs: set[tuple[str, str]] = set()  # two characters that stood for one or two
        self._memory: dict[str, str] = {}
        self._mended: dict[str, str] = {}
        self._windows: tuple[set[str], ...] = (set(),) * 6  # those with a weight, of the features 1 to 5 and 9
        self._told: dict[tuple[str, str, str], tuple[str, float]] = {}
        self.verdicts: dict[str, str] = {}

    @cached_property
    def _heads(self) -> set[str]:
        return {w[:n] for w in self.known for n in range(1, AFFIX + 1)}

    @cached_property
    def _tails(self) -> set[str]:
        return {w[-n:] for w in self.known for n in range(1, AFFIX + 1)}

    def train_words(self, pairs: Counter) -> None:
        data = []
        for (noisy, right), n in sorted(pairs.items()):
            ops = edits(noisy, right)
            if ops:
                data.append((noisy, ops))
                for c, o in zip(noisy, ops):
                    opts = self.options.setdefault(c, [KEEP])
                    if o not in opts:
                        opts.append(o)
                self.pairs.update((noisy[i : i + 2], ops[i]) for i in range(len(ops) - 1) if ops[i] not in (KEEP, DROP) and ops[i + 1] == DROP)
        for _ in range(EPOCHS):
            for w, ops in data:
                before = KEEP
                for i, o in enumerate(ops):
                    if len(self.options[w[i]]) > 1:
                        self.chars.learn(_char_features(w, i, before), self.options[w[i]], o)
                    before = o
        self.chars.average()
        self._windows = tuple({f[1:] for f in self.chars.weights if f[0] == k} for k in "123459")
        self._told.clear()

    def word(self, w: str, name: bool = False) -> str:
        """The word as the editor would write it; lower case in, lower case out. ``name``: it
        begins with a capital, so a known word that looks much like it proves nothing."""
        if w in self.known:
            return w
        key = w if not name else w.title()
        got = self._memory.get(key)
        if got is None:
            if len(self._memory) > 300_000:
                self._memory.clear()
            got = self._memory[key] = self._edit(w, name)
        return got

    def _pass(self, w: str) -> tuple[str, float]:
        out, before, margin = list(w), KEEP, 0.0
        p, told = f"^^^{w}$$$", self._told
        two, after, three, later, both, wide = self._windows
        for i, c in enumerate(w):
            opts = self.options.get(c)
            if opts and len(opts) > 1:
                # all windows of a place were learnt together, so none has a weight where a part of it
                # has none: places that share those with a weight share the operation
                left, right = p[i + 2 : i + 4], p[i + 3 : i + 5]
                left = "" if left not in two else long if (long := p[i + 1 : i + 4]) in three else left
                right = "" if right not in after else long if (long := p[i + 3 : i + 6]) in later else right
                if left and right and p[i + 2 : i + 5] in both:
                    left = p[i : i + 7]
                    left, right = left if left in wide else left[1:6], ""
                key = (left, right or c, before)
                if (got := told.get(key)) is None:
                    if len(told) > 300_000:
                        told.clear()
                    got = told[key] = self.chars.best(_char_features(w, i, before), opts)
                o, ahead = got
                margin += ahead
                if o != KEEP:
                    out[i] = "" if o == DROP else o
            else:
                o = KEEP
            before = o
        return "".join(out), margin

    def _open(self, base: str) -> range:
        """Where one operation may make a known word: what stands before and after it begins and
        ends one."""
        n = len(base)
        head = next((k for k in range(min(AFFIX, n), 0, -1) if base[:k] in self._heads), 0)
        tail = next((k for k in range(min(AFFIX, n), 0, -1) if base[-k:] in self._tails), 0)
        return range(0 if tail == AFFIX else max(0, n - tail - 2), n if head == AFFIX else min(n, head + 1))

    def _edit(self, w: str, name: bool = False) -> str:
        edited, margin = self._pass(w)
        if edited in self.known:
            return edited
        if edited != w and (again := self._pass(edited)[0]) in self.known:
            return again
        # the editor's runners-up: one operation that it has seen, if that makes a known word
        if len(w) > 3 and not name:
            for base in dict.fromkeys((w, edited)):
                for i in self._open(base):
                    for o in self.options.get(base[i], ())[1:]:
                        if o == DROP:
                            continue
                        one, two = base[:i] + o + base[i + 1 :], base[:i] + o + base[i + 2 :]
                        if one in self.known:
                            return one
                        if two in self.known and (base[i : i + 2], o) in self.pairs:
                            return two
        # not a word known to be right: only a clear sign counts
        return edited if edited != w and (_impossible(w) or (margin >= CLEAR and not name)) else w

    def misread(self, core: str) -> bool:
        low = core.lower()
        if low in self.known or len(low) < 3 or not LETTERS.search(low) or ROMAN.match(low):
            return False
        if not low.isascii() and mark_cost(core):
            return False
        for p in re.split("[-'’‐]", low):
            if len(p) > 2 and p not in self.known and (new := self.word(p, core[0].isupper() and not core.isupper())) != p:
                # a letter outside ASCII that would change speaks of encoding, not of recognition
                if p.isascii() or sorted(c for c in p if c > "\x7f") == sorted(c for c in new if c > "\x7f"):
                    return True
        return False

    def _mend(self, core: str) -> str:
        if not self.misread(core):
            return core
        new = "".join(p if p in "-'’‐" else self.word(p) for p in re.split("([-'’‐])", core.lower()) if p)
        return new.upper() if core.isupper() and len(core) > 1 else new[:1].upper() + new[1:] if core[:1].isupper() else new

    def mended(self, text: str) -> str:
        """The text with its misread words as the editor writes them; blanks become one."""
        out = []
        for w in text.split():
            core = w.strip(EDGE)
            if core and core not in self.known:
                new = self._mended.get(core)
                if new is None:
                    if len(self._mended) > 300_000:
                        self._mended.clear()
                    new = self._mended[core] = self._mend(core)
                if new != core:
                    w = w.replace(core, new)
            out.append(w)
        return " ".join(out)

    def join_features(self, left: str, mark: str, right: str) -> list[str]:
        a, b = left.lower(), right.lower()
        joined, compound = self.word(a + b) in self.known, f"{a}-{b}" in self.known
        return [f"m{mark}", f"j{joined}", f"c{compound}", f"jc{joined}{compound}", f"l{a in self.known}{b in self.known}", f"u{right[:1].isupper()}", f"mu{mark}{right[:1].isupper()}"]

    def joins_here(self, left: str, mark: str, right: str) -> bool:
        return self.joins.best(self.join_features(left, mark, right), ["part", "join"])[0] == "join"


#: Lead of the edited over the unedited word from which an unknown result is believed.
CLEAR = 12.0


def _impossible(w: str) -> bool:
    """A sign or digit inside a word."""
    return bool(re.search(r"[^\W\d_][@!|\d$][^\W\d_]|^[@!5][^\W\d_]{2}|[^\W\d_]{2}[@1!0569]$", w)) and not re.search(r"\d{2}", w)


def _breaks(text: str) -> list[tuple[int, int, str, str, str]]:
    """(start, end, left, mark, right) of what ``BREAK`` finds."""
    out, end = [], 0
    for m in MARK_BREAK.finditer(text):
        start = at = m.start()
        while start > end and (c := text[start - 1]).isalnum() and not c.isdecimal():
            start -= 1
        if start < at:
            end = m.end()
            out.append((start, end, text[start:at], m[1], m[2]))
    return out


def _joined(text: str, breaks: list[tuple[int, int, str, str, str]]) -> str:
    out, done = [], 0
    for start, end, left, _, right in breaks:
        out += text[done:start], left, right
        done = end
    return "".join(out) + text[done:]


def _cores(text: str) -> list[str]:
    """Words without the punctuation at their ends; signs inside them stay."""
    return [c for c in (w.strip(EDGE) for w in text.split()) if c]


def _without_number(line: str) -> str:
    """Without a number that a wide gap parts from the rest; most lines have no such gap."""
    words = line.split()
    return line if " ".join(words) == line.strip() else NUMBER_AFTER.sub("", NUMBER_BEFORE.sub("", line))


def _cells(line: str) -> bool:
    """Whether ``CELLS`` finds any; without one of its signs it isn't asked."""
    return ("  " in line or "|" in line or "\t" in line or line.count(",") > 1 or ";" in line or line.lstrip()[:1] in "│├┌└") and bool(CELLS.search(line))


def _marked(core: str) -> bool:
    """Whether ``MARKED`` holds; entries known by their end are looked for where a line has such an end."""
    return bool(MARKED.match(core) if core[-1:] in "0123456789ivxlc" else MARKER.match(core))


def _plain(line: str) -> str:
    """A line as it is compared with titles: words only, without numbers at the ends."""
    t = _without_number(line)
    return " ".join(re.findall(r"[^\W\d_]+", PREFIX.sub("", t).lower()))


def _value(line: str) -> int | None:
    """The number of a line that is one, roman or not."""
    found = VALUE.search(line)
    if not found:
        return None
    n = found[0].lower()
    if n.isdigit():
        return int(n) if len(n) < 10 else None
    v = [ROMANS[c] for c in n]
    return sum(-x if x < y else x for x, y in zip(v, [*v[1:], 0]))


def _form(line: str) -> str:
    core = line.strip()
    if len(core) > LONG_LINE:
        return "prose"
    return "cells" if _cells(line) else "marked" if _marked(core) else "short" if core[-1:] not in ".!?:;,-" and len(core.split()) <= 5 else "upper" if core.isupper() else "prose"


FACTS = (
    "number", "year", "attached", "prefix", "dot", "heading", "upper", "lower_start", "sentence", "hyphen", "words", "named", "repeats", "own",
    "blank", "place", "inner", "after", "beside", "wide",
)
#: Facts that are taken together.
TOGETHER = (
    ("repeats", "words"), ("repeats", "sentence"), ("named", "words"), ("words", "sentence"), ("blank", "words"), ("place", "sentence"), ("place", "words"),
    ("upper", "sentence"), ("attached", "sentence"), ("attached", "own"), ("number", "year"), ("number", "repeats"), ("number", "after"), ("beside", "repeats"),
    ("beside", "words"), ("inner", "named"), ("inner", "repeats"), ("own", "number"), ("own", "repeats"), ("own", "words"),
    ("named", "sentence"), ("upper", "words"), ("upper", "repeats"), ("upper", "beside"), ("attached", "beside"), ("prefix", "beside"), ("dot", "beside"),
    ("named", "beside"), ("wide", "sentence"), ("prefix", "sentence"), ("dot", "sentence"), ("heading", "words"),
    ("upper", "place", "beside"), ("place", "beside", "sentence"), ("place", "words", "sentence"), ("upper", "words", "sentence"),
    ("wide", "words", "sentence"), ("after", "words", "sentence"), ("lower_start", "words", "sentence"),
)
_TOGETHER = tuple((name, tuple(map(FACTS.index, name))) for name in TOGETHER)


def line_facts(line: str, place: str, beside: str, repeats: int, title: float, chapter: float, seen: dict | None = None) -> tuple:
    """What the model knows of a line, in the order of ``FACTS``. ``beside``: what :func:`_ends`
    says about the lines around. ``seen`` remembers words."""
    core = line.strip()
    body = _without_number(core).strip()
    words = body.count(" ") + 1
    number = bool(NUMBER_LINE.match(core))
    blank, inner, after, form, wide = beside.split(",")
    if number or len(body) > LONG_LINE:
        own = "no"
    elif readable_share(body, {} if seen is None else seen) < FEW_READABLE:
        own = "odd"
    else:
        own = "cells" if _cells(body) else "marked" if _marked(body) else "no"
    upper = words > 1 and body.isupper()
    return (
        number,
        number and after != "end" and bool(YEAR_END.match(core)),
        len(body) < len(core) and not number,
        bool(PREFIX.match(body)),
        " · " in body,
        core[:1] == "#",
        upper,
        body[:1].islower() and body != body.lower(),
        body[-1:] in ".!?,;" and not number,
        body[-1:] in BREAK_MARKS and not number,
        "1" if words < 2 else "2" if words < 4 else "4" if words < 10 else "10" if words < 17 else "17",
        "title" if title >= 0.8 else "chapter" if chapter >= 0.8 else "no",
        "1" if repeats < 2 else "2" if repeats < 4 else "4",
        own,
        blank,
        place,
        inner,
        after,
        form,
        wide,
    )


def line_features(facts: tuple) -> list[str]:
    f = [f"{k}={v}" for k, v in zip(FACTS, facts)]
    f += [f"{'&'.join(name)}={','.join(str(facts[i]) for i in at)}" for name, at in _TOGETHER]
    return [*f, "bias"]


def _ends(text: str) -> list[tuple[str, str, str]]:
    """(place, line, beside) of the first and last lines, and of the lines next to them where
    those have the form of a page number. ``beside``: whether a blank line parts it from the
    text, whether it is an inner one, how the text next to it ends or begins, the form of the
    line next to it, and how wide it is against the widest line of the page."""
    lines = text.split("\n")
    bare = list(map(str.rstrip, lines))
    at = [i for i, x in enumerate(bare) if x]
    if not at:
        return []
    n, widest = len(at), max(map(len, bare))
    picked = [(0, "first", False), (n - 1, "last", False)]
    if NUMBER_LINE.match(lines[at[0]]):
        picked.append((1, "first", True))
    if NUMBER_LINE.match(lines[at[-1]]):
        picked.append((n - 2, "last", True))
    out, seen = [], set()
    for k, place, inner in picked:
        if not 0 <= k < n or k in seen:
            continue
        seen.add(k)
        near = k + 1 if place == "first" else k - 1
        if not 0 <= near < n:
            blank, after, form = "alone", "none", "none"
        else:
            other = lines[at[near]].strip()
            blank = str(abs(at[k] - at[near]) > 1)
            form = _form(lines[at[near]])
            if place == "first":
                after = "lower" if other[:1].islower() else "start"
            else:
                after = "end" if other[-1] in SENTENCE_END or " · " in other else "open"
        share = len(lines[at[k]].strip()) / widest
        out.append((place, lines[at[k]], f"{blank},{inner},{after},{form},{'full' if share > 0.8 else 'half' if share > 0.5 else 'part'}"))
    return out


@lru_cache(10_000)
def _counts(title: str) -> tuple[tuple[str, int], ...]:
    return tuple(Counter(title).items())


def _alike(plain: str, title: str) -> float:
    """How well a plain line holds or equals a title, 0 to 1."""
    if not title or not plain:
        return 0.0
    if title == plain or (len(title) > 8 and title in plain):
        return 1.0
    if abs(len(title) - len(plain)) > 0.3 * len(title):
        return 0.0
    # the two bounds of SequenceMatcher, without its index: lengths, then characters in common
    both = len(title) + len(plain)
    if 2.0 * min(len(title), len(plain)) / both < 0.85 or 2.0 * sum(min(n, plain.count(c)) for c, n in _counts(title)) / both < 0.85:
        return 0.0
    ratio = SequenceMatcher(None, title, plain, False).ratio()
    return ratio if ratio >= 0.85 else 0.0


def head_candidates(pages: DataFrame, shared: Broadcast) -> DataFrame:
    """First and last lines: ``table_name, job_id, page, place, line, plain, beside``. ``plain``
    has misread words mended; that of a page number is its distance from the page. ``shared``:
    the editor, one broadcast for all passes, so that a worker keeps what it has found of words."""

    def make():
        ed = shared.value

        def plain(line, page):
            if NUMBER_LINE.match(line):
                return "" if (v := _value(line)) is None else f"#{v - page}"
            return _plain(ed.mended(line)) if line.count(" ") < 24 else ""  # no title is a paragraph

        def run(names, jobs, numbers, texts):
            return [(n, j, p, place, line, plain(line, p), beside) for n, j, p, t in zip(names, jobs, numbers, texts) for place, line, beside in _ends(t)]

        return run

    return map_batches(pages, make, "table_name string, job_id bigint, page int, place string, line string, plain string, beside string")


def job_lines(heads: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """``job_id, plain, repeats, chapter`` of the lines that several pages of a job show, or that
    are titles of its chapters. Lines that stand once, nearly all of them, have no row."""
    paragraphs = require(paragraphs, "job_id", "chapter_title")
    plain = F.trim(F.regexp_replace(F.lower("chapter_title"), r"[^\p{L}]+", " "))
    chapters = paragraphs.where("chapter_title is not null and job_id is not null").groupBy("job_id", plain.alias("plain")).agg(F.lit(1.0).alias("chapter"))
    # counts of job and line first, each distinct page once, so that no hot job is in one task
    repeats = (
        heads.where("plain <> ''").groupBy("job_id", "plain", "page").agg(F.lit(1))
        .groupBy("job_id", "plain").agg(F.count("*").cast("int").alias("repeats")).where("repeats > 1")
    )
    return repeats.join(chapters, ["job_id", "plain"], "full")


def _small(df: DataFrame) -> DataFrame:
    """With a broadcast hint where it has few rows."""
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


def with_job(heads: DataFrame, lines: DataFrame, jobs: DataFrame) -> DataFrame:
    """Adds the title of the job, and on how many of its pages a line stands."""
    name = F.regexp_replace(F.regexp_replace(F.lower("filename"), r"^.*/|\.[a-z]+$", ""), r"[^\p{L}]+", " ")
    title = require(jobs, "id", "filename").where("id is not null").groupBy(F.col("id").alias("job_id")).agg(F.first(F.trim(name), True).alias("title"))
    # lines without a form of their own aren't joined: they would all share one key a job
    plain, rest = heads.where("plain <> ''"), heads.where("plain = ''")
    counted = plain.join(_small(lines), ["job_id", "plain"], "left").select(*heads.columns, "repeats", "chapter")
    counted = counted.unionByName(rest.select(*heads.columns, F.lit(1).alias("repeats"), F.lit(0.0).alias("chapter")))
    return counted.join(_small(title), "job_id", "left").select(
        "table_name", "job_id", "page", "place", "line", "plain", "beside", F.coalesce("repeats", F.lit(1)).alias("repeats"), "title", F.coalesce("chapter", F.lit(0.0)).alias("chapter")
    )


def _facts_of(place, line, plain, beside, repeats, title, chapter, seen: dict | None = None) -> tuple:
    return line_facts(line, place, beside, repeats, _alike(plain, title or ""), chapter, seen)


def is_furniture(model: YesNo, facts: tuple) -> bool:
    """Whether a first or last line with these facts is page furniture."""
    return model.says(line_features(facts))


def align(noisy: str, right: str) -> tuple[Counter, list[tuple[str, str, str, bool]]]:
    """Word pairs (noisy, right) and line-end marks with whether the right text joins there."""
    words = set(map(str.lower, _cores(right)))
    marks = []
    for m in BREAK.finditer(noisy):
        a, mark, b = m.groups()
        low = f"{a}-{b}".lower()
        whole = next((w for w in words if w.endswith((a + b).lower()) or (a + b).lower() in w), None)
        if whole or any(low in w for w in words):
            marks.append((a, mark, b, whole is not None))
    joined = BREAK.sub(lambda m: m[1] + m[3] if (m[1] + m[3]).lower() in words else f"{m[1]}{m[2]}{m[3]}", noisy)
    a, b = [w.lower() for w in _cores(joined)], [w.lower() for w in _cores(right)]
    pairs: Counter = Counter()
    for tag, i, j, k, m in SequenceMatcher(None, a, b, False).get_opcodes():
        if tag == "equal":
            pairs.update((w, w) for w in a[i:j])
        elif tag == "replace" and j - i == m - k:
            for x, y in zip(a[i:j], b[k:m]):
                if x != y and abs(len(x) - len(y)) <= 3 and SequenceMatcher(None, x, y, False).ratio() >= 0.5 and not (not x.isascii() and mark_cost(x)):
                    pairs[x, y] += 1
    return pairs, marks


def right_words(gold: DataFrame) -> set[str]:
    """The words of all right paragraphs, and the parts of those with a hyphen or apostrophe."""

    def make():
        def run(texts):
            words = {c.lower() for t in texts for c in _cores(t)}
            return [(x,) for x in words.union(*(re.split("[-'’‐]", w) for w in words)) if x]

        return run

    own = require(gold, "page_id", "text").where("page_id is not null and text is not null").select("text")
    return {r.word for r in map_batches(own, make, "word string").distinct().collect()}


def fit(gold: DataFrame, pages: DataFrame) -> tuple[Editor, dict[str, str]]:
    """The editor, trained on at most ``MAX_GOLD`` pages with known paragraphs, lowest hash
    first, and the right texts of those. The words known to be right are those of all known
    paragraphs."""
    own = require(gold, "page_id", "para_no", "text").where("page_id is not null and text is not null")
    own = own.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("para_no", "text"))), lambda x: x["text"]), "\n").alias("right"))
    own = own.orderBy(F.xxhash64("page_id"), "page_id").limit(MAX_GOLD)
    keyed = pages.withColumn("page_id", F.concat_ws("/", F.col("job_id").cast("string"), F.col("page").cast("string")))
    both = keyed.join(F.broadcast(own), "page_id").dropDuplicates(["table_name", "page_id", "text"])
    rows = both.select("table_name", "page_id", "text", "right").orderBy("page_id", "table_name", "text").collect()  # at most two tables' rows of MAX_GOLD pages
    pairs, marks, known = Counter(), [], right_words(gold)
    rights = {}
    often: Counter = Counter()
    for r in rows:
        rights[r.page_id] = r.right
        often.update(set(map(str.lower, _cores(r.text))))
        p, m = align(r.text, r.right)
        pairs += p
        marks += m
    # words outside the right paragraphs, as in notices, if they come often and never for another
    wrong = {a for a, b in pairs if a != b}
    known.update(w for w, n in often.items() if n >= OFTEN and w not in wrong and not _impossible(w))
    editor = Editor(known)
    editor.train_words(pairs)
    for _ in range(EPOCHS):
        for a, mark, b, joins in marks:
            editor.joins.learn(editor.join_features(a, mark, b), ["part", "join"], "join" if joins else "part")
    editor.joins.average()
    return editor, rights


def line_label(line: str, place: str, inner: bool, titled: bool, right: str) -> str | None:
    """``furniture`` where the right text lacks the line, else ``text``. Last lines, and lines
    beside a page number, may be notices unless they are titled: None, nothing is learnt."""
    words = [w.lower() for w in _cores(line)]
    if NUMBER_LINE.match(line):
        ends = [w.lower() for w in _cores(right)]
        mine = ends[: len(words)] if place == "first" else ends[len(ends) - len(words) :]
        return "text" if words and mine == words else "furniture"
    text = set(map(str.lower, _cores(right)))
    inside = sum(w in text for w in words)
    flat, flat_line = "".join(re.findall(r"\w", right.lower())), "".join(re.findall(r"\w", line.lower()))
    if flat_line in flat or inside >= 0.75 * len(words):
        return "text"
    return None if mark_cost(line) or ((inner or place == "last") and not titled) else "furniture"


def fit_lines(heads: DataFrame, lines: DataFrame, jobs: DataFrame, rights: dict[str, str]) -> YesNo:
    """The model of page furniture, from the lines of the pages in ``rights`` and from as many
    lines of lists, tables, marked headings and signs, lowest hash first."""
    spark, model = heads.sparkSession, YesNo()
    wanted = spark.createDataFrame([(k,) for k in sorted(rights)], "page_id string")
    page_id = F.concat_ws("/", F.col("job_id").cast("string"), F.col("page").cast("string"))
    known = heads.join(F.broadcast(wanted), page_id == wanted["page_id"], "left_semi")
    # rows of cells or entries, headings marked as such, and lines of signs
    rows = (F.col("beside").rlike(",(cells|marked),[a-z]+$") | F.col("line").rlike(r"^\s*#") | ~F.col("line").rlike(r"[aeiouAEIOU][\p{L}]|[\p{L}][aeiouAEIOU]")) & ~F.col("plain").startswith("#")
    other = heads.where(rows).orderBy(F.xxhash64("job_id", "page", "line"), "job_id", "page", "table_name", "place", "line").limit(MAX_GOLD)
    data = []
    for r in with_job(known, lines, jobs).orderBy("job_id", "page", "table_name", "place", "line").collect():
        titled = bool(r.chapter) or _alike(r.plain, r.title or "") >= 0.8 or " · " in r.line
        if label := line_label(r.line, r.place, r.beside.split(",")[1] == "True", titled, rights[f"{r.job_id}/{r.page}"]):
            data.append((line_features(_facts_of(*r[3:])), label == "furniture"))
    for r in with_job(other, lines, jobs).orderBy("job_id", "page", "table_name", "place", "line").collect():
        # a line that returns is left out, unless it is a row itself
        if r.repeats == 1 or CELLS.search(r.line) or MARKED.match(r.line.strip()):
            data.append((line_features(_facts_of(*r[3:])), False))
    for _ in range(LINE_EPOCHS):
        for f, label in data:
            model.learn(f, label)
    model.average()
    return model


def all_pages(results: DataFrame, engine_pages: DataFrame) -> DataFrame:
    a = require(results, "job_id", "page_number", "extracted_text").toDF("job_id", "page", "text").withColumn("table_name", F.lit("ocr_results"))
    b = require(engine_pages, "job_id", "page", "text").withColumn("table_name", F.lit("page_results"))
    both = a.unionByName(b).where("job_id is not null and page is not null").where(F.col("text").rlike(r"\S"))
    return both.select("table_name", "job_id", "page", "text")


def word_noise(pages: DataFrame, shared: Broadcast) -> DataFrame:
    """Hyphenation and misread words: ``table_name, job_id, page, kind``."""

    def make():
        ed = shared.value
        known, verdict = ed.known, ed.verdicts

        def judge(word: str) -> str:
            core = word.strip(EDGE)
            if not core:
                return "sign"
            return "right" if core in known or core.lower() in known else "bad" if ed.misread(core) else "unknown"

        def run(names, jobs, numbers, texts):
            rows = []
            for n, j, p, text in zip(names, jobs, numbers, texts):
                breaks = _breaks(text) if any(m in text for m in ("-\n", "‐\n", "¬\n", "\xad\n", "- \n", "¬ \n", "‐ \n", "\xad \n")) else ()
                if breaks:
                    if any(ed.joins_here(*b[2:]) for b in breaks):
                        rows.append((n, j, p, "hyphenation"))
                    text = _joined(text, breaks)
                words = text.split()
                told = list(map(verdict.get, words))
                if None in told:
                    if len(verdict) > 400_000:
                        verdict.clear()
                        told = [None] * len(words)
                    for w in {w for w, t in zip(words, told) if t is None}:
                        verdict[w] = judge(w)
                    told = list(map(verdict.get, words))
                bad, right = told.count("bad"), told.count("right")
                seen = bad + told.count("unknown")
                if bad >= MIN_MISREAD and right >= MIN_KNOWN * (right + seen):
                    rows.append((n, j, p, "misread"))
            return rows

        return run

    return map_batches(pages, make, "table_name string, job_id bigint, page int, kind string")


def _mark(line: str) -> int:
    return zlib.crc32(line.encode("utf-8", "surrogatepass"))


def furniture(heads: DataFrame, model: YesNo) -> DataFrame:
    """Running heads and page numbers among first and last lines with their job's titles:
    ``table_name, job_id, page, kind, mark``; ``mark`` stands for the line."""
    shared = heads.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value
        seen: dict = {}
        decided: dict[tuple, bool] = {}  # there are only so many combinations of facts

        def run(names, jobs, numbers, *columns):
            rows = []
            for n, j, p, *row in zip(names, jobs, numbers, *columns):
                facts = _facts_of(*row, seen)
                if (told := decided.get(facts)) is None:
                    told = decided[facts] = is_furniture(model, facts)
                if told:
                    line = row[1]
                    number = NUMBER_LINE.match(line)
                    rows.append((n, j, p, "page_number" if number else "running_head", _mark(line)))
                    if not number and (NUMBER_BEFORE.match(line) or NUMBER_AFTER.search(line)):
                        rows.append((n, j, p, "page_number", _mark(line)))
            return rows

        return run

    return map_batches(heads, make, "table_name string, job_id bigint, page int, kind string, mark bigint")


def _scanned(results, engine_pages, jobs, paragraphs, gold) -> tuple[DataFrame, Broadcast, DataFrame]:
    """Pages, editor, and the furniture on the pages."""
    pages = all_pages(results, engine_pages)
    editor, rights = fit(gold, pages)
    shared = pages.sparkSession.sparkContext.broadcast(editor)
    heads = cut(head_candidates(pages, shared))
    lines = cut(job_lines(heads, paragraphs))
    return pages, shared, furniture(with_job(heads, lines, jobs), fit_lines(heads, lines, jobs, rights))


def noise(results: DataFrame, engine_pages: DataFrame, jobs: DataFrame, paragraphs: DataFrame, gold: DataFrame) -> DataFrame:
    """Each page and kind of noise on it, once."""
    pages, shared, found = _scanned(results, engine_pages, jobs, paragraphs, gold)
    return word_noise(pages, shared).unionByName(found.drop("mark")).dropDuplicates(["table_name", "job_id", "page", "kind"])


def _repaired(text: str, ed: Editor, drop: set[int]) -> list[str]:
    """Continuous paragraphs: without the first and last lines whose marks are in ``drop``, joined, words mended."""
    lines = text.split("\n")
    at = [i for i, x in enumerate(lines) if x.strip()]
    for i in {*at[:2], *at[-2:]}:
        if _mark(lines[i]) in drop:
            lines[i] = ""
    body = "\n".join(lines)
    body = BREAK.sub(lambda m: m[1] + m[3] if ed.joins_here(m[1], m[2], m[3]) else m[0].replace("\n", ""), body)

    return [m for para in re.split(r"\n[ \t]*\n|\n(?= {2,}\S)", body) if (m := ed.mended(para))]


def repair(results: DataFrame, engine_pages: DataFrame, jobs: DataFrame, paragraphs: DataFrame, gold: DataFrame) -> DataFrame:
    """``table_name, job_id, page, para_no, text``: every page as continuous paragraphs."""
    pages, shared, found = _scanned(results, engine_pages, jobs, paragraphs, gold)
    drop = cut(found.groupBy("table_name", "job_id", "page").agg(F.collect_set("mark").alias("marks")))
    # the texts stay where they are as long as the rows of the pages with furniture may be sent to them
    both = pages.join(F.broadcast(drop) if drop.count() <= BROADCAST_ROWS else drop, ["table_name", "job_id", "page"], "left")

    def make():
        ed = shared.value

        def run(names, jobs_, numbers, texts, marks):
            rows = []
            for n, j, p, t, d in zip(names, jobs_, numbers, texts, marks):
                rows += [(n, j, p, k + 1, x) for k, x in enumerate(_repaired(t, ed, set(d or ())))]
            return rows

        return run

    return map_batches(both, make, "table_name string, job_id bigint, page int, para_no int, text string")
