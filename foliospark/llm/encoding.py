"""Problem 5: text that was decoded with the wrong character encoding.

A page is looked at through its *marks*: its words with characters outside ASCII or with
escapes of such characters. A plausibility cost says how odd a mark is in English, French,
German and Spanish text. From every odd mark a best-first search runs over encode, decode
and unescape steps: the cheapest state is opened first, states seen before (by hash) are not
opened again, and it ends when no state is left, so the cheapest text that can be reached is
the one found. Every step must make a mark less odd, or shorter and no odder, so the
states of a mark are finite without a cap on steps or states.

Words are searched by themselves because a page can be wrong in parts and in several ways.
The page decides between texts of equal cost (the path that explains most of its marks),
and its paths also mend marks that are wrong without being odd.

Null and blank text is no case; ids are kept as they are, repeated rows included.
"""

from __future__ import annotations

import heapq
import html
import re
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import map_batches, require

ESCAPE = r"&(?:amp;)*(?:[a-zA-Z]{2,8}|#x?[0-9a-fA-F]{2,6});|\\u[0-9a-fA-F]{4}|\\x[0-9a-fA-F]{2}"
MARK = re.compile(rf"[^ \t\r\n]*?(?:[^\x00-\x7f]|{ESCAPE})[^ \t\r\n]*")
LOST_BLANK = re.compile(r"([ÃĂ├√Г])(?=[.,;:!?]?$)")
LOST_QUOTE = re.compile(r"â€(?=[\x00-\x7f]|$)")
RUN = re.compile(r"[^\x00-\x7f]+")
_BACKSLASHED = re.compile(r"\\(?:u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2}))")
ESCAPES = re.compile(ESCAPE)

#: Encodings that texts are wrongly read with, and that they are really in (fixed values).
READ_AS = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "cp866", "iso8859_2", "iso8859_15")
REALLY = ("utf-8", "cp1252", "mac_roman", "cp850", "cp437")

#: Letters of the four languages and of the names in them (fixed values).
LOWER = set("àâäáåæçèéêëíîïñóôöøœùúûüß")
UPPER = set("ÀÂÄÁÅÆÇÈÉÊËÍÎÏÑÓÔÖØŒÙÚÛÜ")
OPEN, CLOSE, MIDDLE = set("“„«‘¿¡‚‹"), set("”»’“‘…›"), set("—–·•▪‐©®™×−")
BEFORE_DIGIT, AFTER_DIGIT = set("£€§$¥±"), set("°%²³½¼¾€º")

STEP_COST = 0.5
#: Cost of the escape of a character outside ASCII.
ESCAPE_COST = 3
#: From this gain, or this cost that nothing lowers, a page counts as wrongly decoded.
MIN_GAIN, MIN_COST = 2.5, 5.0

FOUND = "result_id bigint, path string, cost_before double, cost_after double, restorable boolean"


def _box(c: str) -> bool:
    return "─" <= c <= "▟"


def _private(c: str) -> bool:
    return "\ue000" <= c <= "\uf8ff"


def _unescaped(s: str) -> str:
    """Without HTML escapes, however often they were escaped themselves, and backslash escapes."""
    while "&" in s and (out := html.unescape(s)) != s:
        s = out
    return _BACKSLASHED.sub(lambda m: chr(int(m[1] or m[2], 16)), s) if "\\" in s else s


@lru_cache(maxsize=1 << 17)
def mark_cost(mark: str) -> float:
    """How odd a mark is; 0 where it is rightly written."""
    total, n = 0.0, len(mark)
    if "&" in mark or "\\" in mark:
        total += ESCAPE_COST * sum(not _unescaped(x).isascii() for x in ESCAPES.findall(mark))
    for k, c in enumerate(mark):
        if c < "\x80":
            continue
        a, b = mark[k - 1] if k else " ", mark[k + 1] if k + 1 < n else " "
        if c == "\ufffd" or "\x80" <= c < "\xa0":
            total += 6
        elif c in LOWER:
            # within or beside a word, after no capital but the first; rightly alone only à
            if a.isupper() and b.isupper():
                total += 4
            elif (a.isspace() or a in ",.;:?") and b.isspace() and c != "à":
                total += 3
            elif c == "ß" and not (a.isalnum() or b.islower()):
                total += 3
        elif c in UPPER:
            if a.isalpha() and a.islower():
                total += 4
            elif not (b.isalpha() or (a.isalpha() and a.isupper()) or (c == "À" and b.isspace())):
                total += 3
            elif b.isalpha() and b.islower() and a.isalpha():
                total += 3
        elif c in BEFORE_DIGIT or c in AFTER_DIGIT:
            ok = (c in BEFORE_DIGIT and (b.isdigit() or b.isspace())) or (c in AFTER_DIGIT and a.isdigit())
            total += 0 if ok else 3
        elif c in OPEN or c in CLOSE:
            ok = (c in OPEN and not a.isalnum() and not b.isspace()) or (c in CLOSE and not a.isspace() and (c in "’‘…" or not b.isalnum()))
            ok = ok or (c in "«»" and not a.isalnum() and (a.isspace() or b.isspace()))
            total += 0 if ok else 2
        elif c in MIDDLE:
            total += 3 if c not in "—–‐·" and a.isalpha() and b.isalpha() else 0
        elif c == "\xad" or c == "¬":
            total += 0 if a.isalpha() and (b.isspace() or c == "\xad") else 3
        elif c == "\xa0":
            total += 0
        elif _private(c):
            total += 0
        elif _box(c):
            total += 0 if all(x.isspace() or _box(x) for x in (a, b)) else 4
        elif c.isalpha():
            total += 5
        else:
            total += 3
    return total


def _sloppy_encode(s: str, name: str) -> bytes:
    """Encode; C1 controls pass through where the code page leaves their byte free."""
    try:
        return s.encode(name)
    except UnicodeEncodeError:
        out = bytearray()
        for c in s:
            try:
                out += c.encode(name)
            except UnicodeEncodeError:
                if not (name.startswith("cp125") and "\x80" <= c < "\xa0"):
                    raise
                out.append(ord(c))
        return bytes(out)


@lru_cache(maxsize=1 << 17)
def step(mark: str, read_as: str, really: str) -> str:
    """The mark re-encoded and decoded; unchanged where that isn't possible."""
    if read_as == "unescape":
        return ESCAPES.sub(lambda m: c if not (c := _unescaped(m[0])).isascii() else m[0], mark)
    if really == "utf-8":
        # bytes that were lost because they look like blanks or are no characters
        mark = LOST_BLANK.sub("\\1\xa0", mark)
        mark = LOST_QUOTE.sub("â€\x9d", mark)
    return RUN.sub(lambda m: _recoded(m[0], read_as, really), mark)


@lru_cache(maxsize=1 << 16)
def _recoded(run: str, read_as: str, really: str) -> str:
    try:
        return _sloppy_encode(run, read_as).decode(really)
    except (UnicodeEncodeError, UnicodeDecodeError):
        return run


STEPS = [(a, b) for a in READ_AS for b in REALLY if a != b] + [("unescape", "")]


def _strange(mark: str) -> float:
    """Cost of a state; symbols of private code points that a step brings forth are odd."""
    return mark_cost(mark) + sum(map(_private, mark))


@lru_cache(maxsize=1 << 16)
def search(mark: str) -> tuple[float, float, tuple]:
    """(cost now, least cost that can be reached, paths that reach it). It ends when a text
    without cost is found and no state as cheap is left, else when every state was opened."""
    start = least = _strange(mark)
    ends = {()}
    seen, heap, order = {hash(mark)}, [(start, 0, start, mark, ())], 0
    while heap:
        rank, _, cost, state, path = heapq.heappop(heap)
        if not least and rank > STEP_COST * min(map(len, ends)):
            break
        for a, b in STEPS:
            nxt = step(state, a, b)
            if nxt == state or (c := _strange(nxt)) > cost or (c == cost and len(nxt) >= len(state)):
                continue
            way = (*path, (a, b))
            if c < least:
                least, ends = c, set()
            if c == least:  # another way to a text that is known already counts for the page
                ends.add(way)
            if (h := hash(nxt)) not in seen:
                seen.add(h)
                order += 1
                heapq.heappush(heap, (c + STEP_COST * len(way), order, c, nxt, way))
    return start, least, tuple(sorted(ends))


def marks_of(text: str) -> tuple[str, ...]:
    return tuple(dict.fromkeys(MARK.findall(text)))


def restore(text: str, mended: dict[str, str]) -> str:
    return MARK.sub(lambda m: mended.get(m[0], m[0]), text) if mended else text


def _walk(mark: str, path: tuple) -> str:
    """The mark after a page's path, each step of which holds where it makes it no odder."""
    for a, b in path:
        if (n := step(mark, a, b)) != mark and _strange(n) <= _strange(mark):
            mark = n
    return mark


def diagnose(text: str) -> tuple[str, float, float, bool, dict] | None:
    """None for rightly decoded text, else paths, costs, whether all of it could be restored,
    and what each wrong mark becomes."""
    marks = marks_of(text)
    odd = [m for m in marks if mark_cost(m)]
    if not odd:
        return None
    found = {m: search(m) for m in odd}
    before, after = sum(f[0] for f in found.values()), sum(f[1] for f in found.values())
    if before - after < MIN_GAIN and before < MIN_COST:
        return None
    # the paths of any mark are tried on all: first comes what explains most odd marks, then the
    # shorter path, then the one that changes more of the marks without cost (it spares none by chance)
    plain = [m for m in marks if m not in found]
    reach = {w: {m: n for m in odd if _strange(n := _walk(m, w)) == found[m][1] < found[m][0]} for w in {w for _, _, ends in found.values() for w in ends if w}}
    spared = lru_cache(maxsize=None)(lambda way: sum(_walk(m, way) == m for m in plain))
    better = lambda way: (-len(reach[way]), len(way), spared(way), way)
    mended, used = {}, set()
    for m, (cost, least, _) in found.items():
        if least < cost:
            own = [w for w in reach if m in reach[w]]
            top = max(len(reach[w]) for w in own)  # only those that lead are compared further
            way = min((w for w in own if len(reach[w]) == top), key=better)
            mended[m] = reach[way][m]
            used.add(way)
    used = sorted(used, key=better)
    # marks without cost come along where a path of the page changes them and leaves none
    for m in plain:
        if (new := next((n for w in used if (n := _walk(m, w)) != m), m)) != m:
            mended[m] = new
    return " | ".join(" ".join(f"{a}>{b}" for a, b in w) for w in used), before, after, after == 0, mended


def wrongly_decoded(df: DataFrame, id_col: str = "id", text_col: str = "extracted_text", with_text: bool = False) -> DataFrame:
    """One row for each wrongly decoded text. ``with_text`` adds ``restored_text``."""
    pages = require(df, id_col, text_col).where(F.col(text_col).rlike(r"[^\x00-\x7f]|&#?\w{2,8};|\\[ux][0-9a-fA-F]{2}"))

    def make():
        def run(ids, texts):
            rows = []
            for i, text in zip(ids, texts):
                if got := diagnose(text):
                    rows.append((i, *got[:4], *([restore(text, got[4])] if with_text else [])))
            return rows

        return run

    return map_batches(pages, make, FOUND + (", restored_text string" if with_text else ""))
