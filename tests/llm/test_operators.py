"""The training-data operators against brute force, round trips and odd tables."""

from __future__ import annotations

import random
import statistics
from collections import Counter

import pytest
from pyspark.sql import functions as F

from foliospark.llm import boilerplate, encoding, leakage, mixing, quantiles, queries, repetition, scannoise, splitting, subjects, textstats
from foliospark.llm.base import fold, fold_words

PROSE = "The old captain left the harbour before the storm, and nobody in the village asked where he went. It was a quiet evening with little wind."
LIST = "\n".join(f"{k}. item {k} (shelf)" for k in range(1, 15))
TABLE = "\n".join(["Name      Sum      Year"] + [f"row{k}      {k * 37}      19{k + 10}" for k in range(12)])
JUNK = "kWqkzvhv;nf zMPPcVzt,w jzg gsM\nrs TWt,GTbNcsxHbjshBBkBMGWR.Nr\nVzrtc hhPDhM.;V,HnPnnhNNXnkwCb"


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def pages(spark, data, extra=True):
    df = spark.createDataFrame(data, "id bigint, job_id bigint, page_number int, extracted_text string")
    return df.selectExpr("*", "'x' AS text", "1 AS n", "'y' AS source", "2 AS result_id", "'z' AS _t", "0 AS page") if extra else df


ODD = [(1, None, None, None), (None, 1, 1, ""), (3, 1, None, " \n \t"), (4, None, 2, "a"), (5, 1, 3, "word " * 30000), (6, 1, 3, "word " * 30000), (7, 1, 4, "x" * 50000)]


# ---- problem 1 ----


def brute_share(words, n=5):
    covered = [False] * len(words)
    for i in range(len(words) - n + 1):
        if any(words[j : j + n] == words[i : i + n] for j in range(i)):
            covered[i : i + n] = [True] * n
    return sum(covered) / len(words) if words else 0.0


def test_stretch_share_is_brute_force():
    rng = random.Random(3)
    for size in (0, 3, 5, 6, 12, 40):
        for _ in range(30):
            words = [rng.choice("abc") for _ in range(size)]
            want = brute_share(words) if size > 5 else 0.0
            assert repetition.stretch_share(words) == pytest.approx(want)


def test_repetition_finds_repeating_pages(spark):
    other = "Nine herons stood on a frozen pond near our mill while Anna counted every feather twice for her small notebook."
    data = [(k, 1, k, f"{PROSE} Number {k} of {k * 7}. {other[: 40 + k]}") for k in range(20)]
    data += [(100, 1, 100, " ".join([PROSE] * 4)), (101, 1, 101, "\n".join(["Page left blank on purpose by the printer."] * 9)), (102, 1, 102, "\n".join([JUNK] * 4))]
    got = rows(repetition.repetitive(repetition.repetition(pages(spark, data + ODD))), "result_id")
    assert (100,) in got and (101,) in got and (102,) not in got and (5,) in got and (6,) in got
    assert not [g for g in got if g[0] is not None and g[0] < 5]


def test_em_trusts_the_rules_that_agree():
    post, rates, prior = repetition.fit({"11111": 50, "00000": 900, "1-1--": 10, "00001": 40, "-----": 5})
    assert post["11111"] > 0.99 and post["00000"] < 0.01 and post["00001"] < 0.5 and 0.01 < prior < 0.2
    assert repetition.fit({})[0] == {}


def test_the_posterior_decides_and_no_filter_does(spark):
    """Neither *every rule that votes says so* nor *some rule says so* gives the rows."""
    other = "Nine herons stood on a frozen pond near our mill while Anna counted every feather twice for her small notebook."
    data = [(k, 1, k, f"{PROSE} Number {k} of {k * 7}. {other[: 40 + k]}") for k in range(40)]
    data += [(100 + k, 1, k, " ".join([f"{PROSE} Number {k}."] * 4)) for k in range(6)]
    # one sentence that never ends: the sentence rule votes against
    data += [(200 + k, 1, k, " ".join([f"then we went down to mill number {k} and sat there"] * 4)) for k in range(6)]
    # one line again and again between others: the line rule alone votes for it
    own = [f"{a}{b}{c}o {a}{c}{b}i" for a in "bdfgk" for b in "aeiou" for c in "lmnr"]
    data += [(300 + k, 1, k, "\n".join(x for w in own[k * 9 : k * 9 + 30] for x in (w, "of wintergrain"))) for k in range(3)]
    by = {r.result_id: r for r in repetition.repetition(pages(spark, data)).collect()}
    got = {i for i, r in by.items() if r.p_repetitive >= repetition.PROBABLE}
    assert got == {*range(100, 106), *range(200, 206)}
    assert got != {i for i, r in by.items() if "1" in r.pattern and "0" not in r.pattern}
    assert got != {i for i, r in by.items() if "1" in r.pattern}


def test_readable_of_every_page(spark):
    got = {r.result_id: (r.readable, r.p_repetitive) for r in repetition.repetition(pages(spark, [(1, 1, 1, JUNK), (2, 1, 2, PROSE), (3, 1, 3, "\n".join([JUNK] * 5))])).collect()}
    assert not got[1][0] and got[2][0] and got[3] == (False, 0.0)


# ---- problem 2 ----


def test_kinds(spark):
    data = [(k, 1, k, PROSE + f" This was in {1800 + k}. " + PROSE) for k in range(40)]
    data += [(50, 1, 1, LIST), (51, 1, 1, TABLE), (52, 1, 1, JUNK), (53, 1, 1, PROSE.upper()), (54, 1, 1, PROSE + "\n\n- one\n- two\n- three")]
    got = {r.result_id: r.kind for r in textstats.page_kinds(pages(spark, data)).collect()}
    assert {k: got[k] for k in (50, 51, 52, 53, 54)} == {50: "list", 51: "table", 52: "junk", 53: "prose", 54: "prose"}
    assert set(got.values()) == {"prose", "list", "table", "junk"} and all(got[k] == "prose" for k in range(40))


def test_statistics_of_odd_texts(spark):
    got = textstats.statistics(pages(spark, ODD)).collect()
    assert {r.result_id for r in got} == {4, 5, 6, 7}
    assert all(0 <= r.readable_share <= 1 and 0 <= r.symbol_ratio <= 1 for r in got)


def test_sketches_of_days_merge_to_the_whole(spark):
    stats = textstats.statistics(pages(spark, [(k, k % 3, k, PROSE * (1 + k % 7)) for k in range(60)]))
    by_day = textstats.sketches(stats.withColumn("day", F.col("result_id") % 5), "day")
    a = textstats.quartiles(textstats.merged(by_day)).collect()
    b = textstats.quartiles(textstats.sketches(stats)).collect()
    assert [r._q_words for r in a] == [r._q_words for r in b]


def test_the_sketches_decide_the_kind(spark):
    """The same page is in the tail of one corpus and usual in another."""
    data = [(k, 1, k, f"The house of number {k} stood by the water and nobody asked for it. " + PROSE) for k in range(30)]
    kind = lambda rows: {r.result_id: r.kind for r in textstats.page_kinds(pages(spark, rows)).collect()}
    page = LIST + "\n" + PROSE
    assert kind([*data, (99, 1, 99, page)])[99] == "list"
    assert kind([*data[:3], *[(200 + k, 1, k, page + f" {k}") for k in range(30)], (99, 1, 99, page)])[99] == "prose"


# ---- problem 3 ----


@pytest.mark.parametrize("text", [PROSE * 40, "x" * 5000, "á" * 3000, "\n\n".join([PROSE] * 30), "word " * 2000, "no.blanks;here" * 500])
@pytest.mark.parametrize("limit,overlap", [(300, 40), (120, 0), (50, 25)])
def test_pieces_lose_nothing(text, limit, overlap):
    parts = splitting.bisect(text, limit, overlap)
    assert parts[0][0] == 0 and parts[-1][1] == len(text) and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))
    assert all(b - max(0, a - overlap) <= limit for a, b, _ in parts)
    if "no" != text[:2] and " " in text:
        assert all(name != "none" for _, _, name in parts)
    assert "".join(text[a:b] for a, b, _ in parts) == text


def test_pieces_of_a_table(spark):
    df = pages(spark, [(1, 1, 1, PROSE * 30), (2, 1, 1, PROSE * 30), (3, 1, 1, PROSE), (4, 1, 1, None), (None, 1, 1, "y" * 999)])
    out = splitting.pieces(df, "id", "extracted_text", 500, 60).collect()
    assert {r.item_id for r in out} == {1, 2, None}
    for r in out:
        assert len(r.text) <= 500 and r.overlap_chars == (60 if r.piece_no > 1 else 0)
    with pytest.raises(ValueError):
        splitting.pieces(df, "id", "extracted_text", 10, 10)


# ---- problem 4 ----


def test_edits_round_trip():
    for a, b in (("prornise", "promise"), ("wmdow", "window"), ("rnoon", "moon"), ("cl0or", "door"), ("same", "same"), ("lceel", "keel")):
        ops = scannoise.edits(a, b)
        assert ops and "".join(c if o == "=" else "" if o == "-" else o for c, o in zip(a, ops)) == b
        assert len(ops) == len(a)


def test_editor_mends_held_out_words():
    rng = random.Random(5)
    words = [f"{a}{b}{c}" for a in ("har", "mi", "ste", "lo", "wan") for b in ("m", "d", "k", "ne") for c in ("er", "ing", "our", "ade")]
    spoil = lambda w: w.replace("m", "rn", 1) if "m" in w else w.replace("e", "c", 1)
    rng.shuffle(words)
    train, test = words[:50], words[50:]
    ed = scannoise.Editor(set(words))
    ed.train_words(Counter({(spoil(w), w): 1 for w in train} | {(w, w): 1 for w in train}))
    told = [w for w in test if spoil(w) != w]
    assert sum(ed.word(spoil(w)) == w for w in told) >= 0.9 * len(told)
    assert all(ed.word(w) == w for w in words)


def test_editor_asks_its_model_once_for_each_context(monkeypatch):
    rng = random.Random(6)
    words = [f"{a}{b}{c}" for a in ("har", "mi", "ste", "lo", "wan") for b in ("m", "d", "k", "ne") for c in ("er", "ing", "our", "ade")]
    spoil = lambda w: w.replace("m", "rn", 1) if "m" in w else w.replace("e", "c", 1)
    ed = scannoise.Editor(set(words))
    ed.train_words(Counter({(spoil(w), w): 1 for w in words[:50]} | {(w, w): 1 for w in words[:50]}))
    unknown = sorted({"".join(rng.choices("abcdehimnorstw", k=rng.randint(1, 12))) for _ in range(2000)} | set(map(spoil, words)))

    def plainly(w):
        out, before, margin = [], "=", 0.0
        for i, c in enumerate(w):
            opts = ed.options.get(c, [])
            o, ahead = ed.chars.best(scannoise._char_features(w, i, before), opts) if len(opts) > 1 else ("=", 0.0)
            out.append(c if o == "=" else "" if o == "-" else o)
            margin, before = margin + ahead, o
        return "".join(out), margin

    def one_operation(base):
        for i in range(len(base)):
            for o in ed.options.get(base[i], ())[1:]:
                if o != "-" and (base[:i] + o + base[i + 1 :] in ed.known or base[:i] + o + base[i + 2 :] in ed.known):
                    yield i

    wanted, asked, best = list(map(plainly, unknown)), [], ed.chars.best
    monkeypatch.setattr(ed.chars, "best", lambda *a: asked.append(a) or best(*a))
    assert list(map(ed._pass, unknown)) == wanted
    assert 0 < len(asked) < 0.2 * sum(len(ed.options.get(c, ())) > 1 for w in unknown for c in w)
    assert any(set(one_operation(w)) for w in unknown)
    assert all(set(one_operation(w)) <= set(ed._open(w)) for w in unknown)


def test_short_ways_of_scan_noise_give_what_the_patterns_give():
    rng = random.Random(7)
    make = lambda signs, n: "".join(rng.choices(signs, k=rng.randint(0, n)))
    for _ in range(4000):
        text = make(["a", "é", "b2", "²", "_", "-", "\xad", "‐", "¬", "\n", "-\n", " ", "\t", "-  \n"], 30)
        found = scannoise._breaks(text)
        assert [(m.start(), m.end(), *m.groups()) for m in scannoise.BREAK.finditer(text)] == found
        assert scannoise.BREAK.sub(r"\1\3", text) == scannoise._joined(text, found)
        line = make(["a", "Bo", "xi", "12", "4", " ", "  ", "\t", "\xa0", "|", ";", ",", ", 7", ".", ". . . .", "│ ", "├─", "(", ")", "[", "]", "—", "-", "page "], 12)
        assert scannoise._without_number(line) == scannoise.NUMBER_AFTER.sub("", scannoise.NUMBER_BEFORE.sub("", line))
        assert scannoise._cells(line) == bool(scannoise.CELLS.search(line))
        assert scannoise._marked(line.strip()) == bool(scannoise.MARKED.match(line.strip()))
        title, plain = make("abc ", 14), make("abc ", 14)
        ratio = scannoise.SequenceMatcher(None, title, plain, False).ratio()
        whole = bool(title and plain) and (title == plain or (len(title) > 8 and title in plain))
        near = bool(title and plain) and abs(len(title) - len(plain)) <= 0.3 * len(title) and ratio >= 0.85
        assert scannoise._alike(plain, title) == (1.0 if whole else ratio if near else 0.0)


def test_noise_of_pages(spark):
    clean = [f"The {a} {b} left the {c} before the evening and nobody noticed the {b} again" for a in ("old", "quiet", "late") for b in ("captain", "neighbour", "stranger") for c in ("harbour", "kitchen", "meeting")]
    spoil = lambda t: t.replace("e", "c", 4)
    head, book = "THE OLD LAMP", "The winter plan"
    res, gold = [], []
    for k, t in enumerate(clean):
        noisy = k % 2 == 0
        body = spoil(t) if noisy else t
        body = body[:40] + "-\n" + body[40:] if body[39].isalpha() and body[40].isalpha() else body
        res.append((k, 7, k + 1, f"{head}\n{body}.\n{k + 1}\n"))
        gold.append((f"7/{k + 1}", "p", 1, t + "."))
    results = pages(spark, res + [(900, None, 1, head), (901, 7, None, head), (902, 7, 800, None), (903, 7, 801, "")])
    engine = spark.createDataFrame([(7, 1, "1"), (7, 1, "1"), (None, 2, "x"), (8, 1, None)], "job_id bigint, page int, text string")
    jobs = spark.createDataFrame([(7, "x/the_old_lamp.pdf"), (8, None)], "id bigint, filename string")
    books = spark.createDataFrame([(7, book), (None, None)], "job_id bigint, chapter_title string")
    g = spark.createDataFrame(gold, "page_id string, label string, para_no int, text string")
    out = rows(scannoise.noise(results, engine, jobs, books, g), "table_name", "job_id", "page", "kind")
    assert len(out) == len(set(out)) and all(r[1] is not None and r[2] is not None for r in out)
    kinds = Counter(r[3] for r in out if r[0] == "ocr_results")
    assert kinds["running_head"] == len(clean) and kinds["page_number"] == len(clean)
    odd = {k + 1 for k in range(0, len(clean), 2)}
    misread = {r[2] for r in out if r[3] == "misread"}
    assert misread <= odd and len(misread) >= 0.8 * len(odd)
    assert ("page_results", 7, 1, "page_number") in out
    fixed = {(r.table_name, r.page): r.text for r in scannoise.repair(results, engine, jobs, books, g).collect()}
    assert fixed["ocr_results", 1] == clean[0] + "."


def test_noise_of_empty_tables(spark):
    empty = pages(spark, [])
    engine = spark.createDataFrame([], "job_id bigint, page int, text string")
    jobs = spark.createDataFrame([], "id bigint, filename string")
    books = spark.createDataFrame([], "job_id bigint, chapter_title string")
    gold = spark.createDataFrame([], "page_id string, para_no int, text string")
    assert scannoise.noise(empty, engine, jobs, books, gold).collect() == []


def test_words_of_all_right_paragraphs_are_known(spark, monkeypatch):
    monkeypatch.setattr(scannoise, "MAX_GOLD", 2)
    words = ["harbour", "kitchen", "lantern", "meadow", "orchard", "well-kept"]
    res = pages(spark, [(k, 7, k, f"The {w} stood there") for k, w in enumerate(words)])
    engine = spark.createDataFrame([], "job_id bigint, page int, text string")
    jobs = spark.createDataFrame([], "id bigint, filename string")
    books = spark.createDataFrame([], "job_id bigint, chapter_title string")
    gold = spark.createDataFrame([(f"7/{k}", 1, f"The {w} stood there.") for k, w in enumerate(words)], "page_id string, para_no int, text string")
    known = scannoise.fit(gold, scannoise.all_pages(res, engine))[0].known
    assert {*words, "the", "well", "kept"} <= known


# ---- problem 5 ----

ACCENTED = ["L’été dernier, la forêt était pleine de bœufs — “très calme”, disait-elle.", "Die Bürger prüften für 20 € die Türen; „alles in großer Eile“, schrieb Köllmar.", "El capitán señaló « aquí » la bahía. ¿Quién? 15° al norte…"]


@pytest.mark.parametrize("text", ACCENTED)
@pytest.mark.parametrize("really,read", [("utf-8", "cp1252"), ("utf-8", "mac_roman"), ("utf-8", "cp437"), ("utf-8", "cp850"), ("utf-8", "cp1251"), ("cp1252", "mac_roman"), ("cp1252", "cp850")])
def test_restores_what_was_wrongly_read(text, really, read):
    try:
        wrong = text.encode(really).decode(read)
    except UnicodeError:
        pytest.skip("the encoding can't hold this text")
    if wrong == text:
        pytest.skip("nothing went wrong")
    got = encoding.diagnose(wrong)
    assert got is not None
    assert encoding.restore(wrong, got[4]) == text


def test_one_page_in_five_wrong_encodings():
    parts = zip(("forêt", "pleine", "été", "señaló", "Bürger", "großer", "bahía"), ("cp1252", "cp1252", "mac_roman", "cp437", "cp850", "cp1251", "cp1252"))
    got = encoding.diagnose(wrong := " ".join(w.encode().decode(e) for w, e in parts))
    assert encoding.restore(wrong, got[4]) == "forêt pleine été señaló Bürger großer bahía" and got[3]


def test_wrong_four_times_over():
    wrong = ACCENTED[0]
    for _ in range(4):
        wrong = wrong.encode().decode("latin-1")
    assert encoding.restore(wrong, encoding.diagnose(wrong)[4]) == ACCENTED[0]


@pytest.mark.parametrize("wrong", ["un caf&eacute; au lait", "un caf&amp;eacute; au lait", "un caf&#xE9; au lait", r"un caf\u00e9 au lait", r"un caf\xC3\xA9 au lait", r"un caf\xc3\xa9 au lait"])
def test_escapes_are_found_and_restored(spark, wrong):
    got = encoding.wrongly_decoded(pages(spark, [(1, 1, 1, wrong), (2, 1, 1, "Smith &amp; Sons, C:\\users")]), with_text=True).collect()
    assert [(r.result_id, r.restored_text, r.restorable) for r in got] == [(1, "un café au lait", True)]


def test_pages_of_other_scripts_end():
    for text in ("Съешь же ещё этих мягких французских булок " * 9, "ξεσκεπάζω την ψυχοφθόρα βδελυγμία " * 9, "ÃƒÂ©" * 2000, "│├───┼───" * 300):
        encoding.diagnose(text)


def test_twice_wrong_and_lost():
    twice = ACCENTED[1].encode().decode("cp1252", "replace").encode("cp1252", "replace").decode("latin-1")
    assert encoding.diagnose(ACCENTED[0].encode().decode("latin-1").encode().decode("latin-1")) is not None
    assert encoding.diagnose(twice) is not None and encoding.diagnose("At 17� the family left the old house.")[3] is False


@pytest.mark.parametrize("text", [*ACCENTED, PROSE, "", "│ a │ b │\n├───┼───┤", " item one\n item two", "PÂQUELIN À MÜNCHEN", "gr0ßer ü6er añad!ó"])
def test_right_text_is_no_case(text):
    assert encoding.diagnose(text) is None


def test_encoding_table(spark):
    bad = ACCENTED[0].encode().decode("cp1252", "replace")
    got = encoding.wrongly_decoded(pages(spark, [(10, 1, 1, bad), (11, 1, 1, bad), (12, 1, 1, ACCENTED[0]), *ODD]), with_text=True)
    assert rows(got, "result_id") == [(10,), (11,)]


# ---- problem 6 ----


def test_frequent_lines_and_sequences(spark):
    notice = ["Property of the Trust, No. 7", "Send this page to a friend"]
    data = [(k, 1, k, "\n".join([f"Unlike any other {chr(97 + k)}{chr(98 + k % 20)}", *notice, "12"])) for k in range(12)]
    data += [(k + 100, 1, k, "\n".join(notice)) for k in range(5)]  # saved again
    data += [(k + 200, 2, k, "Rare line") for k in range(7)]
    data += [(k + 300, 3, k, "Common line" if k < 8 else f"other {chr(97 + k // 26)}{chr(97 + k % 26)}x") for k in range(60)]
    df = pages(spark, data + ODD[:4])
    got = rows(boilerplate.frequent_lines(df), "source", "line", "pages")
    assert got == [(1, "property of the trust no #", 12), (1, "send this page to a friend", 12)]
    seqs = {tuple(r.lines): r.pages for r in boilerplate.sequences(df).collect()}
    assert seqs == {("property of the trust no #", "send this page to a friend"): 12}
    assert rows(boilerplate.lines_of(boilerplate.sequences(df)), "source", "line") == [g[:2] for g in got]
    out = {r.id: (r.cleaned_text, r.removed_lines) for r in boilerplate.cleaned(df, boilerplate.sequences(df)).collect()}
    assert out[0] == ("Unlike any other ab\n12", 2) and out[200] == ("Rare line", 0)
    assert boilerplate.frequent_lines(pages(spark, [])).collect() == [] == boilerplate.sequences(pages(spark, [])).collect()


def test_prefixspan_is_brute_force(spark):
    rng = random.Random(9)
    docs = [[rng.choice("abcd") + "a" for _ in range(5)] for _ in range(30)]
    df = pages(spark, [(k, 1, k, "\n".join(d)) for k, d in enumerate(docs)])

    got = {tuple(r.lines): r.pages for r in boilerplate.sequences(df, min_pages=6, min_share=0.0).collect()}
    frequent = {x for x in "abcd" if sum(x + "a" in d for d in docs) >= 6}
    short = [[x for x in d if x[0] in frequent] for d in docs]
    every = Counter(s for d in short for s in {tuple(d[i:j]) for i in range(len(d)) for j in range(i + 1, len(d) + 1)})
    often = {s: n for s, n in every.items() if n >= 6}
    closed = {s: n for s, n in often.items() if not any(m == n and s in (t[1:], t[:-1]) for t, m in often.items() if len(t) == len(s) + 1)}
    assert got == closed and max(map(len, got)) > 1


def test_sequences_of_a_long_notice(spark):
    notice = [f"Clause {x} of the notice" for x in "abcdefgh"]
    data = [(k, 1, k, "\n".join([f"Own line {chr(97 + k)}x", *notice[:4], f"Own line {chr(97 + k)}y", *notice[4:]])) for k in range(10)]
    data += [(k + 20, 1, k + 20, notice[2]) for k in range(3)]
    got = {tuple(r.lines): (r.length, r.pages) for r in boilerplate.sequences(pages(spark, data)).collect()}
    assert got == {tuple(x.lower() for x in notice): (8, 10), (notice[2].lower(),): (1, 13)}


# ---- problem 7 ----


def test_summaries_keep_their_bound(spark):
    rng = random.Random(1)
    data = [(1 if k % 3 else k % 50, rng.choice([rng.random(), rng.expovariate(0.1), 5.0])) for k in range(60000)]
    data += [(1, None), (2, float("nan")), (3, -1.0), (None, 4.0), (4, float("inf"))]
    df = spark.createDataFrame(data, "g int, v double").selectExpr("*", "1 AS n", "'a' AS vals").repartition(7)
    s = quantiles.summaries(df, ["g"], "v", 0.01)
    days = quantiles.combine(quantiles.summaries(df.withColumn("d", (F.col("v") * 10).cast("int") % 4), ["g", "d"], "v", 0.01), ["g"], 0.01)
    for stored in (s, days):
        by = {}
        for g, v in data:
            if v is not None and v == v and 0 <= v < float("inf"):
                by.setdefault(g, []).append(v)
        got = {r.g: r for r in quantiles.percentiles(stored, ["g"]).collect()}
        assert set(got) == set(by)
        for g, r in got.items():
            values = sorted(by[g])
            assert r.n == len(values) and r.rank_error <= max(1, 2 * 0.01 * r.n)
            for name, q in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99)):
                import bisect
                import math

                rank = min(max(math.ceil(q * len(values)), 1), len(values))
                lo, hi = bisect.bisect_left(values, r[name]) + 1, bisect.bisect_right(values, r[name])
                assert lo - r.rank_error <= rank <= hi + r.rank_error
    assert max(len(r.vals) for r in s.collect()) < 2000
    coarse = quantiles.within(df, ["g"], "v", 0.02).collect()
    assert len(coarse) == len({g for g, v in data if v is not None and 0 <= v < float("inf")}) and all(all(r[2:]) for r in coarse)
    assert min(len(r.vals) / r.n for r in quantiles.summaries(df, ["g"], "v", 0.02).collect()) < 0.2  # it did compress


def test_median_of_few(spark):
    df = spark.createDataFrame([(1, float(k)) for k in range(9)], "g int, v double")
    r = quantiles.percentiles(quantiles.summaries(df, ["g"], "v"), ["g"]).collect()[0]
    assert r.p50 == statistics.median(range(9)) and r.rank_error == 0
    assert quantiles.summaries(df.limit(0), ["g"], "v").collect() == []


def test_metric_percentiles_of_days_are_those_of_the_whole(spark, tmp_path):
    rng = random.Random(8)
    data = [(k, k % 3, rng.choice([rng.random(), -1.0, float("nan"), None]), k % 5) for k in range(200)]
    df = spark.createDataFrame(data, "id bigint, job_id bigint, avg_page_time double, d int")
    df.selectExpr("id", "job_id", "avg_page_time", "timestamp'2024-01-01 12:00:00' + make_dt_interval(d) AS timestamp").write.parquet(f"{tmp_path}/ocr_metrics.parquet")
    whole, days = (queries.QUERIES[q](spark, str(tmp_path)) for q in ("p7_metric_percentiles", "p7_metric_percentiles_by_day"))
    assert rows(days, *whole.columns) == rows(whole, *whole.columns) and days.count() == 3


# ---- problem 8 ----


def test_wu_manber_is_brute_force():
    rng = random.Random(2)
    items = [[rng.choice("abcde") for _ in range(n)] for n in (9, 9, 9, 5, 3, 2, 1)]
    runs = [4, 4, 4, 3, 2, 1, 1]
    text = [rng.choice("abcdefg") for _ in range(3000)]
    want = {k: sorted((i, j) for i in range(len(w) - r + 1) for j in range(len(text) - r + 1) if text[j : j + r] == w[i : i + r]) for k, (w, r) in enumerate(zip(items, runs))}
    got = leakage.WuManber(items, runs).search(text)
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}


def test_ten_thousand_items_read_the_documents_once(spark, tmp_path):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(5))
    items = [(k, " ".join(word() for _ in range(25))) for k in range(10_000)]
    spark.createDataFrame([(k, f"Before it. {items[k * 500][1]} After it.") for k in range(20)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/d")
    out = leakage.leaks(spark.createDataFrame(items, "item_id bigint, text string"), spark.read.parquet(f"{tmp_path}/d"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1
    assert rows(out, "item_id", "doc_id") == sorted((k * 500, k) for k in range(20))


def test_short_items_leak_by_half(spark):
    docs = spark.createDataFrame([(1, "We saw a grey heron over there"), (2, "The heron grey was away"), (3, "nothing at all")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "grey heron standing still"), (2, "grey heron mill"), (3, "Heron"), (4, "a grey heron flew over the old mill")], "item_id bigint, text string")
    assert rows(leakage.leaks(items, docs), "item_id", "doc_id") == [(1, 1), (2, 1), (3, 1), (3, 2)]


def test_leaks(spark):
    rng = random.Random(4)
    vocab = ["".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(6)) for _ in range(400)]
    item = " ".join(rng.choice(vocab) for _ in range(60))
    other = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    w = item.split()
    noisy = " ".join(x if k % 9 else x[:2] + "0" + x[3:] for k, x in enumerate(w))
    wrapped = "-\n".join([item[:100], item[100:]]) if item[99].isalpha() and item[100].isalpha() else item.replace(" ", "\n", 12)
    data = [
        (10, other(80) + " " + item + " " + other(30)), (11, other(20) + " " + " ".join(w[20:56]) + " " + other(20)), (12, other(50) + " " + " ".join(w[:18]) + " " + other(50)),
        (13, other(30) + " " + noisy + " " + other(9)), (14, wrapped), (15, None), (16, ""), (17, " ".join(w[:30]) + "\n 17 Some running head \n" + " ".join(w[30:])), (18, item.upper()), (18, item.upper()),
    ]
    docs = spark.createDataFrame(data, "doc_id bigint, text string").selectExpr("*", "5 AS item_id", "'q' AS words")
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, other(50)), (None, item)], "item_id bigint, text string")
    assert rows(leakage.leaks(items, docs), "item_id", "doc_id") == [(1, d) for d in (10, 11, 13, 14, 17, 18)]
    assert rows(leakage.leaks(items, docs, pass_words=60), "item_id", "doc_id") == [(1, d) for d in (10, 11, 13, 14, 17, 18)]
    assert leakage.leaks(items.limit(0), docs).collect() == [] and leakage.leaks(items, docs.limit(0)).collect() == []


def test_fold():
    assert fold("Brücken") == fold("Bruecken") and fold_words("l’Été — cœur") == ["l", "ete", "cour"] and fold_words("har-\nbour") == ["harbour"]


# ---- problem 9 ----


def test_sainte_lague_quotas():
    assert mixing.sainte_lague({"a": 53, "b": 24, "c": 23}, 7, {"a": 9, "b": 9, "c": 9}) == {"a": 3, "b": 2, "c": 2}
    assert mixing.sainte_lague({"a": 1, "b": 1}, 10, {"a": 2, "b": 99}) == {"a": 2, "b": 8}
    assert mixing.sainte_lague({"a": 1}, 5, {"a": 0}) == {"a": 0}


def test_mixture_reaches_its_shares(spark):
    rng = random.Random(6)
    data = [(k, src, " ".join(rng.choice(["red", "green", "blue", "house"]) for _ in range(rng.randint(20, 60)))) for k, src in enumerate(["big"] * 400 + [" BIG "] * 10 + ["small"] * 40 + ["off"] * 50)]
    data += [(None, "big", "x"), (9000, None, "x"), (9001, "big", None), (9002, "big", "")]
    docs = spark.createDataFrame(data, "doc_id bigint, source string, text string").selectExpr("*", "1 AS tokens", "2 AS shard")
    targets = spark.createDataFrame([("big", 0.7, 1), ("small", 0.25, 3), ("none", 0.05, 2), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    sel = mixing.select(docs, targets)
    got = {r.source: r for r in mixing.report(sel, targets.where("source is not null")).collect()}
    assert got["none"].tokens == 0 and abs(got["big"].actual_share - 0.7 / 0.95) < 0.02 and abs(got["small"].actual_share - 0.25 / 0.95) < 0.02
    assert max(r.copies for r in sel.collect() if r.source == "small") <= 3 and max(r.copies for r in sel.collect() if r.source == "big") == 1
    assert rows(sel, "doc_id", "copies") == rows(mixing.select(docs.repartition(5), targets), "doc_id", "copies")
    assert mixing.select(docs.limit(0), targets).collect() == []


# ---- problem 10 ----


def test_subjects(spark):
    rng = random.Random(7)
    terms = {"sea": ["anchor", "keel", "harbour", "mast"], "law": ["court", "jury", "verdict", "statute"]}
    plain = ["house", "garden", "window", "evening", "letter", "table"]

    def text(*about):
        s = []
        for k in range(10):
            own = terms[about[k // 2 % len(about)]] if about and k % 2 == 0 else plain
            s.append(f"The {rng.choice(own)} stood beside the {rng.choice(plain)} all day.")
        return " ".join(s)

    data, labels = [], []
    for k in range(120):
        about = [("sea",), ("law",), (), ("sea", "law")][k % 4]
        data.append((k, text(*about)))
        if k < 80:
            labels += [(k, s) for s in about or ("none",)]
    data += [(500, None), (501, ""), (502, "\n"), (None, text("sea"))]
    docs = spark.createDataFrame(data, "doc_id bigint, text string").selectExpr("*", "'s' AS subject", "1 AS share")
    lab = spark.createDataFrame(labels + [(None, "sea"), (3, None)], "doc_id bigint, subject string")
    got = subjects.assign(docs, lab)
    by = {}
    for r in got.collect():
        by.setdefault(r.doc_id, set()).add(r.subject)
    for k in range(80, 120):
        assert by.get(k, set()) == set([("sea",), ("law",), (), ("sea", "law")][k % 4]), k
    make = {r.subject: r.documents for r in subjects.makeup(docs, got).collect()}
    assert make["none"] == 34 and make["sea"] == 60
    assert subjects.assign(docs, lab.limit(0)).collect() == [] and subjects.assign(docs.limit(0), lab).collect() == []


def test_subjects_of_held_out_documents(spark):
    """Fitted on two thirds of the hand labels of the test tables, held against the rest."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "subject_labels"))
    docs = docs.join(labels.select("doc_id").distinct(), "doc_id", "left_semi")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    got = subjects.assign(docs, labels.where(~held))
    want = set(rows(labels.where(held).where("subject <> 'none'").distinct(), "doc_id", "subject"))
    mine = set(rows(got.join(labels.where(held).select("doc_id").distinct(), "doc_id", "left_semi"), "doc_id", "subject"))
    both = len(want & mine)
    print(f"held out: {len(want)} labelled, {len(mine)} given, {both} of them the same")
    assert both >= 0.85 * len(want) and both >= 0.85 * len(mine)  # some labels are wrong


def test_every_term_that_passes_is_kept(spark):
    own = [f"{a}{b}{c}ing" for a in "bcdfghjklm" for b in "aeiou" for c in "bdfgklmnp"]
    data = [(k, f"We saw {' '.join(own)} there.") for k in range(6)] + [(k, "We saw nothing there at all.") for k in range(6, 60)]
    docs = spark.createDataFrame(data, "doc_id bigint, text string")
    lab = spark.createDataFrame([(k, "sea" if k < 6 else "none") for k in range(60)], "doc_id bigint, subject string")
    got = subjects.learn_terms(docs, lab)
    assert len(own) == 450 and set(own) <= set(got)


# ---- columns that clash ----


def test_columns_that_differ_in_case_only(spark):
    other = lambda df, *names: df.select("*", *[F.lit(None).cast("string").alias(n) for n in names])
    res = other(spark.createDataFrame([(k, 1, k, PROSE * (1 + 3 * (k % 2))) for k in range(10)], "id bigint, job_id bigint, page_number int, extracted_text string"), "ID", "Job_Id", "Extracted_Text", "PAGE_NUMBER")
    assert len(repetition.repetitive(repetition.repetition(res)).collect()) == 5
    assert textstats.page_kinds(res).count() == 10
    assert splitting.pieces(res, "id", "extracted_text", 300, 30, False).count() > 0
    assert encoding.wrongly_decoded(res).count() == 0
    often = boilerplate.frequent_lines(res, min_pages=5)
    assert often.count() == 2
    assert boilerplate.cleaned(res, often.select("source", F.array("line").alias("lines"))).where("removed_lines = 1").count() == 10
    num = spark.createDataFrame([(1, 2.0)], "g int, v double").selectExpr("*", "'x' AS G", "'y' AS V")
    assert quantiles.percentiles(quantiles.summaries(num, ["g"], "v"), ["g"]).collect()[0].p50 == 2.0
    docs = other(spark.createDataFrame([(1, "a", PROSE)], "doc_id bigint, source string, text string"), "TEXT", "Source", "DOC_ID")
    items = other(spark.createDataFrame([(1, PROSE)], "item_id bigint, text string"), "Text")
    assert rows(leakage.leaks(items, docs), "item_id", "doc_id") == [(1, 1)]
    assert mixing.select(docs, other(spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int"), "SOURCE")).count() == 1
    assert subjects.assign(docs, other(spark.createDataFrame([(1, "x")], "doc_id bigint, subject string"), "Subject")).count() == 0
    jobs = other(spark.createDataFrame([(1, "a/b.pdf")], "id bigint, filename string"), "Filename")
    books = other(spark.createDataFrame([(1, "T")], "job_id bigint, chapter_title string"), "JOB_ID")
    gold = other(spark.createDataFrame([("1/1", 1, PROSE)], "page_id string, para_no int, text string"), "TEXT")
    engine = other(spark.createDataFrame([(1, 1, PROSE)], "job_id bigint, page int, text string"), "Page")
    scannoise.noise(res, engine, jobs, books, gold).collect()
