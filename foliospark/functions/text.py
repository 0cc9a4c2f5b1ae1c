"""Scalar text functions as column expressions: quality, redaction, clean-up, mathematics.

Null goes through as null unless a function says otherwise; none of them needs a UDF.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chars import BROKEN, NEITHER, NOT_PRINTABLE, SPACE, SPACES, occurrences, strip, words

# ---- quality and routing of native text ----

#: Score of a faultless text, penalties with their limits, and decisions (fixed values).
FAULTLESS = 0.98
PASS_FROM, HYBRID_FROM = 0.85, 0.50


def quality(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``character_count``, five ratios, ``quality_score`` and ``decision``. A null text
    counts as empty: all zero, and recognition is required."""
    t = F.col("_t")
    n = F.col("_n")
    base = df.withColumn("_t", strip(F.coalesce(F.col(text), F.lit("")))).withColumn("_n", F.length("_t"))
    # the text is stripped, so parting it at line feeds with the space around them strips every line
    lines = F.filter(F.split(t, rf"[{SPACE}]*\n[{SPACE}]*", -1), lambda x: x != "")
    per = lambda hits: F.when(n == 0, F.lit(0.0)).otherwise(hits / n)
    base = base.select(
        *df.columns,
        n.cast("int").alias("character_count"),
        per(n - occurrences(t, NOT_PRINTABLE)).alias("_p"),
        # most texts hold no such sign: a look is cheaper than a copy
        F.when(t.rlike(BROKEN), per(occurrences(t, BROKEN))).otherwise(F.lit(0.0)).alias("_b"),
        per(n - occurrences(t, NEITHER)).alias("_a"),
        per(occurrences(t, SPACES)).alias("_s"),
        F.when(F.size(lines) > 0, 1.0 - F.size(F.array_distinct(lines)) / F.size(lines)).otherwise(F.lit(0.0)).alias("_d"),
    )
    c = F.col("character_count")
    fault = lambda when, by: F.when(when, F.lit(by)).otherwise(F.lit(0.0))
    score = (
        F.lit(FAULTLESS) - fault(c < 50, 0.7) - fault(F.col("_p") < 0.90, 0.3) - fault(F.col("_b") > 0.02, 0.5)
        - fault(F.col("_a") < 0.65, 0.4) - fault(F.col("_d") > 0.35, 0.3)
    )
    base = base.withColumn("_score", F.when(c == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))))
    sanity = F.when(c == 0, 0.0).when(F.col("_s") > 0.4, 1.0 - F.abs(F.col("_s") - 0.18)).otherwise(1.0)
    decision = F.when(F.col("_score") >= PASS_FROM, "pass_native").when(F.col("_score") >= HYBRID_FROM, "hybrid_required").otherwise("ocr_required")
    return base.select(
        *df.columns,
        "character_count",
        F.round("_p", 4).alias("printable_ratio"),
        F.round("_b", 4).alias("unicode_replacement_ratio"),
        F.round("_a", 4).alias("alphanumeric_ratio"),
        F.round(sanity, 4).alias("whitespace_sanity"),
        F.round("_d", 4).alias("duplicate_ratio"),
        F.round("_score", 4).alias("quality_score"),
        decision.alias("decision"),
    )


# ---- redaction ----

#: Substitutions in the order in which they apply: long digit runs before telephone numbers (fixed values).
REDACTIONS = (
    (r"\b\d{3}[- ]\d{2}[- ]\d{4}\b", "[REDACTED-SSN]"),
    (r"\b[A-Z]{2}[0-9]{2}[A-Z0-9]{12,30}\b", "[REDACTED-IBAN]"),
    (
        r"\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13}|3(?:0[0-5]|[68][0-9])[0-9]{11}"
        r"|6(?:011|5[0-9]{2})[0-9]{12}|(?:2131|1800|35\d{3})\d{11}|(?:\d[ -]*?){13,16})\b",
        "[REDACTED-CARD]",
    ),
    (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", "[REDACTED-EMAIL]"),
    (r"\beyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+\b", "[REDACTED-API-KEY]"),
    (r"\b(AKIA[0-9A-Z]{16})\b", "[REDACTED-API-KEY]"),
    (r"\b(sk-[A-Za-z0-9_-]{20,})\b", "[REDACTED-API-KEY]"),
    (r"\b(ghp_[A-Za-z0-9]{36}|github_pat_[A-Za-z0-9_]{22,})\b", "[REDACTED-API-KEY]"),
    (r"\b(?:\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]\d{3}[-.\s]\d{4}\b", "[REDACTED-PHONE]"),
    (r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b", "[REDACTED-IP]"),
)


def redact(c: Column) -> Column:
    """Personal data and secrets replaced; null becomes empty."""
    c = F.coalesce(c, F.lit(""))
    for pattern, mark in REDACTIONS:
        c = F.regexp_replace(c, pattern, mark)
    return c


# ---- clean-up ----

#: What a Word or XML document can't hold: controls, surrogates and everything above U+FFFD.
NOT_XML = r"[^\x09\x0A\x0D\x{20}-\x{D7FF}\x{E000}-\x{FFFD}]"
HYPHEN_BREAK = r"(\b[A-Za-z]+)-\s*\n\s*([a-z][A-Za-z]*\b)"
IMAGE_EMBED = r"!\[[^\]]*\]\([^)]*\)"


def xml_safe(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), NOT_XML, "")


def dehyphenate(c: Column) -> Column:
    """Join words broken by a hyphen at a line end, if the rest begins with a small letter."""
    return F.regexp_replace(c, HYPHEN_BREAK, "$1$2")


def reflow(c: Column) -> Column:
    """Lines joined into paragraphs; blank lines part them."""
    lines = F.filter(F.transform(F.split(c, "\n[ \t]*\n", -1), lambda p: strip(F.regexp_replace(dehyphenate(p), rf"[{SPACE}]*\n[{SPACE}]*", " "))), lambda p: p != "")
    return F.array_join(lines, "\n\n")


#: Kinds of blocks whose lines are joined (fixed values).
FLOWING = ("text", "column", "index_item")


def reflow_block(kind: Column, lines: Column) -> Column:
    """A block's ``lines`` (``text, confidence``) as one span ``text, confidence``: lines of flowing
    kinds are joined into paragraphs, others stay lines; the confidence is the first line's."""
    own = F.array_join(F.transform(lines, lambda x: F.coalesce(x["text"], F.lit(""))), "\n")
    first = F.get(F.filter(lines, lambda x: strip(F.coalesce(x["text"], F.lit(""))) != ""), F.lit(0))
    return F.struct(F.when(kind.isin(*FLOWING), reflow(own)).otherwise(own).alias("text"), first["confidence"].alias("confidence"))


def paragraphs(c: Column) -> Column:
    """The paragraphs of a text as ``text, level``: blank lines part them, a first line of one or
    two signs makes a heading of that level without its signs, else the level is null."""
    parts = F.filter(F.transform(F.split(c, "\n[ \t]*\n", -1), strip), lambda p: p != "")
    level = lambda p: F.when(p.startswith("## "), F.lit(2)).when(p.startswith("# "), F.lit(1))
    return F.transform(parts, lambda p: F.struct(strip(F.regexp_replace(p, "^#{1,2} ", "")).alias("text"), level(p).alias("level")))


def without_images(c: Column) -> Column:
    return strip(F.regexp_replace(c, IMAGE_EMBED, ""))


def normal_space(c: Column) -> Column:
    return strip(F.regexp_replace(c, rf"[{SPACE}]+", " "))


def tokens(c: Column) -> Column:
    """Lower-case words of letters, digits and apostrophes, as an array."""
    return F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9']+)"), F.lit(1))


def token_estimate(c: Column) -> Column:
    """Rough number of model tokens: four for three words, at least one."""
    return F.greatest(F.lit(1), F.floor(words(c) * 4 / 3)).cast("int")


# ---- language to recognition models ----

#: Models by language; anything else is read as English (fixed values).
MODELS = {
    "en": ["en"], "fr": ["en", "fr"], "de": ["en", "de"], "es": ["en", "es"], "pt": ["en", "pt"],
    "ar": ["en", "ar"], "zh": ["en", "ch_sim"], "zh-cn": ["en", "ch_sim"], "zh-tw": ["en", "ch_tra"],
}


def models_for(lang: Column) -> Column:
    known = F.create_map(*[x for k, v in MODELS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.coalesce(known[F.lower(lang)], F.array(F.lit("en")))


#: The commonest words of a language; a word of two languages counts for both (fixed values).
LANGUAGE_WORDS = {
    "en": "the of and to in was that it for is on with as had be at by not this are from but have an which or were they".split(),
    "fr": "le la les des et du une est dans qui que pour au sur ne se pas plus par avec ce il son sont aux ont cette mais".split(),
    "de": "der die das und den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie".split(),
    "es": "el la los las de que y en un una por con no su para es al lo como más se del fue ha sus pero este entre".split(),
    "it": "il lo gli le di che è un una per non con del della si da sono dei nel alla come più anche dal ha delle questo".split(),
    "pt": "o os as do da em um uma para com não que se na no por mais dos ao das foi ele à como mas seu sua".split(),
    "nl": "de het een van en in is dat op te zijn met voor niet aan er om ook als bij naar maar dan ze uit nog wordt".split(),
}


def language(c: Column) -> Column:
    """The language whose commonest words a text has most of, the first among equals; English
    where there are none, or no text."""
    words = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"(\p{L}+)"), F.lit(1))
    count = lambda w, lang: F.size(F.filter(w, lambda x: x.isin(LANGUAGE_WORDS[lang])))
    votes = F.transform(F.array(words), lambda w: F.array(*[count(w, k) for k in LANGUAGE_WORDS]))[0]
    at = F.array_position(votes, F.array_max(votes))
    return F.when(F.array_max(votes) == 0, "en").otherwise(F.element_at(F.array(*map(F.lit, LANGUAGE_WORDS)), at.cast("int")))


# ---- mathematics ----

#: Marks of a formula, names of Greek letters and operators in order of replacement (fixed values).
MATH_MARK = (
    r"\b(?:sin|cos|tan|log|ln|exp|det|lim)\b|[\^_+\-*/=<>\x{b1}\x{222b}\x{2211}\x{220f}\x{221a}\x{221e}"
    r"\x{3b1}\x{3b2}\x{3b3}\x{3b4}\x{3b8}\x{3bb}\x{3bc}\x{3c0}\x{3c3}\x{3c9}]|\b[a-zA-Z]\s*=\s*[0-9A-Za-z_+\-*/]"
)
FUNCTION_OF = r"^[A-Za-z]\s*\([A-Za-z0-9,\s]+\)\s*="
ASSIGNMENT = r"^[A-Za-z0-9_]+\s*=\s*[-+]?[0-9A-Za-z_]+"
GREEK = ("alpha", "beta", "gamma", "delta", "epsilon", "theta", "lambda", "mu", "pi", "sigma", "omega", "Delta", "Sigma", "Omega", "Phi", "Psi")
OPERATORS = (
    ("sum", "sum"), ("int", "int"), ("prod", "prod"), ("sqrt", "sqrt"), ("+-", "pm"), ("<=", "le"), (">=", "ge"), ("!=", "neq"),
    ("approx", "approx"), ("infty", "infty"), ("->", "rightarrow"), ("<->", "leftrightarrow"), ("times", "times"), ("div", "div"),
)
INLINE = r"\b[a-zA-Z]\s*=\s*[a-zA-Z0-9_+\-*/^]+\b"


def is_formula(c: Column) -> Column:
    t = strip(c)
    many = (F.regexp_count(t, F.lit(MATH_MARK)) >= 3) & (words(t) <= 15)
    return (t != "") & (many | t.rlike(FUNCTION_OF) | (t.rlike(ASSIGNMENT) & t.rlike(r"[+\-*/^]")))


def to_latex(c: Column) -> Column:
    t = F.regexp_replace(strip(c), r"([A-Za-z0-9_^]+)\s*/\s*([A-Za-z0-9_^]+)", r"\\frac{$1}{$2}")
    t = F.regexp_replace(t, r"sqrt\s*\((.*?)\)", r"\\sqrt{$1}")
    for name in GREEK:
        t = F.regexp_replace(t, rf"\b{name}\b", rf"\\{name}")
    for name, to in OPERATORS:
        t = F.regexp_replace(t, rf"\b{name}\b", rf"\\{to}") if name.isalpha() else F.replace(t, F.lit(name), F.lit("\\" + to))
    t = F.regexp_replace(t, r"\^([A-Za-z0-9]{2,})", r"^{$1}")
    return F.regexp_replace(t, r"_([A-Za-z0-9]{2,})", r"_{$1}")


def inline_math(c: Column) -> Column:
    """Each ``x = ...`` as LaTeX between dollar signs: the matches and the parts between
    them are zipped, so no callback is needed."""
    found = F.regexp_extract_all(c, F.lit(f"({INLINE})"), F.lit(1))
    parts = F.split(c, INLINE, -1)
    return F.array_join(
        F.transform(F.arrays_zip(parts.alias("a"), found.alias("b")), lambda x: F.concat(x["a"], F.when(x["b"].isNotNull(), F.concat(F.lit("$"), to_latex(x["b"]), F.lit("$"))).otherwise(F.lit("")))), ""
    )


# ---- export ----

def csv_guard(c: Column) -> Column:
    """A quote before what a spreadsheet would run as a formula."""
    risky = F.regexp_replace(c, r"^\s+", "").rlike(r"^[=+\-@]") | c.rlike(r"^[\t\r]")
    return F.when(risky, F.concat(F.lit("'"), c)).otherwise(c)


def front_matter(m: Column) -> Column:
    """A map as front matter with sorted keys; null values are left out."""
    rows = F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return F.concat(F.lit("---\n"), F.array_join(rows, "\n"), F.lit("\n---\n"))


def status_key(c: Column) -> Column:
    """A status in its plain form: lower case, underscores."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"[\s-]+", "_"), "[^a-z0-9_]", "")


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c
