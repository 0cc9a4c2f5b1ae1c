"""Text intelligence over documents, pages and paragraphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliospark.functions import chars, text
from foliospark.session import table

from .registry import query

_S = chars.SPACE
_STRIP = lambda c: f"regexp_replace({c}, '^[{_S}]+|[{_S}]+$', '', 'g')"
_COUNT = lambda c, p: f"(length({c}) - length(regexp_replace({c}, '{p}', '', 'g')))"


def _quality_sql(table_: str, key: str, column: str) -> str:
    return f"""
    WITH a AS (SELECT {key}, {_STRIP(f"coalesce({column}, '')")} AS t FROM {table_}),
    b AS (SELECT *, length(t) AS n, list_filter(list_transform(string_split(t, chr(10)), lambda x: {_STRIP("x")}), lambda x: x <> '') AS l FROM a),
    c AS (SELECT {key}, n,
      CASE WHEN n = 0 THEN 0.0 ELSE {_COUNT("t", chars.PRINTABLE)}::DOUBLE / n END AS p,
      CASE WHEN n = 0 THEN 0.0 ELSE {_COUNT("t", chars.BROKEN_SIGN)}::DOUBLE / n END AS u,
      CASE WHEN n = 0 THEN 0.0 ELSE {_COUNT("t", chars.ALNUM_OR_SPACE)}::DOUBLE / n END AS a,
      CASE WHEN n = 0 THEN 0.0 ELSE {_COUNT("t", f"[{_S}]")}::DOUBLE / n END AS s,
      CASE WHEN len(l) > 0 THEN 1.0::DOUBLE - len(list_distinct(l))::DOUBLE / len(l) ELSE 0.0 END AS d FROM b),
    e AS (SELECT *, CASE WHEN n = 0 THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, greatest(0.0::DOUBLE,
        0.98::DOUBLE - CASE WHEN n < 50 THEN 0.7::DOUBLE ELSE 0.0 END - CASE WHEN p < 0.90 THEN 0.3::DOUBLE ELSE 0.0 END
        - CASE WHEN u > 0.02 THEN 0.5::DOUBLE ELSE 0.0 END - CASE WHEN a < 0.65 THEN 0.4::DOUBLE ELSE 0.0 END
        - CASE WHEN d > 0.35 THEN 0.3::DOUBLE ELSE 0.0 END)) END AS score FROM c)
    SELECT {key}, n::INT AS character_count, round(p, 4) AS printable_ratio, round(u, 4) AS unicode_replacement_ratio,
      round(a, 4) AS alphanumeric_ratio,
      round(CASE WHEN n = 0 THEN 0.0 WHEN s > 0.4 THEN 1.0 - abs(s - 0.18) ELSE 1.0 END, 4) AS whitespace_sanity,
      round(d, 4) AS duplicate_ratio, round(score, 4) AS quality_score,
      CASE WHEN score >= 0.85 THEN 'pass_native' WHEN score >= 0.5 THEN 'hybrid_required' ELSE 'ocr_required' END AS decision FROM e"""


@query(_quality_sql("ocr_results", "id", "extracted_text"))
def text_quality(spark, sf_dir):
    return text.quality(table(spark, sf_dir, "ocr_results").select("id", "extracted_text"), "extracted_text").drop("extracted_text")


@query(f"SELECT lang, decision, count(*) AS documents, round(avg(quality_score), 4) AS mean_score FROM ({_quality_sql('documents', 'doc_id, lang', 'text')}) GROUP BY 1, 2")
def route_summary(spark, sf_dir):
    q = text.quality(table(spark, sf_dir, "documents").select("lang", "text"))
    return q.groupBy("lang", "decision").agg(F.count("*").alias("documents"), F.round(F.avg("quality_score"), 4).alias("mean_score"))


@query("""
    SELECT r.id, n.result_id IS NOT NULL AS recorded, n.quality_score AS recorded_score, n.decision AS recorded_decision
    FROM ocr_results r LEFT JOIN native_text_quality n ON r.id = n.result_id""")
def recorded_quality(spark, sf_dir):
    """Pages beside the quality that was recorded for them."""
    n = table(spark, sf_dir, "native_text_quality").select("result_id", F.col("quality_score").alias("recorded_score"), F.col("decision").alias("recorded_decision"))
    r = table(spark, sf_dir, "ocr_results").select("id")
    return r.join(n, r.id == n.result_id, "left").select("id", F.col("result_id").isNotNull().alias("recorded"), "recorded_score", "recorded_decision")


def _redact_sql(c: str) -> str:
    out = f"coalesce({c}, '')"
    for pattern, mark in text.REDACTIONS:
        out = f"regexp_replace({out}, '{pattern}', '{mark}', 'g')"
    return out


@query(f"SELECT doc_id, {_redact_sql('text')} AS redacted FROM documents")
def pii_redact(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.redact(F.col("text")).alias("redacted"))


_MADE = (
    "concat('SSN ', lpad(cast(c_custkey % 900 + 100 as string), 3, '0'), '-', lpad(cast(c_custkey % 90 + 10 as string), 2, '0'), '-', lpad(cast(c_custkey % 9000 + 1000 as string), 4, '0'), "
    "', IBAN DE', lpad(cast(c_custkey % 90 + 10 as string), 2, '0'), '500105175407324931, mail c', cast(c_custkey as string), '@example.org, key AKIA', "
    "upper(substr(md5(cast(c_custkey as string)), 1, 16)), ', token sk-', md5(cast(c_custkey as string)), ', call +1-', lpad(cast(c_custkey % 900 + 100 as string), 3, '0'), '-555-', "
    "lpad(cast(c_custkey % 9000 + 1000 as string), 4, '0'), ', card 4111111111111111, host 10.1.', cast(c_custkey % 256 as string), '.7')"
)


@query(f"SELECT c_custkey, {_redact_sql(_MADE)} AS redacted FROM customer")
def pii_synthetic(spark, sf_dir):
    """Every kind of secret in made-up strings."""
    return table(spark, sf_dir, "customer").select("c_custkey", text.redact(F.expr(_MADE)).alias("redacted"))


@query(
    "WITH m AS (SELECT (regexp_matches(t, '\\[REDACTED-[A-Z]+(-KEY)?\\]')) AS hit, t FROM (SELECT " + _redact_sql("text") + " AS t FROM (SELECT text || ' reach ' || doc_id || '@mail.example or 10.0.0.' || (doc_id % 250) AS text FROM documents))) "
    "SELECT kind, count(*) AS occurrences FROM (SELECT unnest(regexp_extract_all(t, '\\[REDACTED-([A-Z-]+)\\]', 1)) AS kind FROM m WHERE hit) GROUP BY 1"
)
def pii_counts(spark, sf_dir):
    signed = F.concat("text", F.lit(" reach "), F.col("doc_id").cast("string"), F.lit("@mail.example or 10.0.0."), (F.col("doc_id") % 250).cast("string"))
    d = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(text.redact(signed), F.lit(r"\[REDACTED-([A-Z-]+)\]"), F.lit(1))).alias("kind"))
    return d.groupBy("kind").agg(F.count("*").alias("occurrences"))


@query(f"SELECT id, md5(regexp_replace(coalesce(extracted_text || chr(1) || 'x' || chr(128512) || chr(11), ''), '{text.NOT_XML}', '', 'g')) AS digest FROM ocr_results")
def xml_sanitize(spark, sf_dir):
    dirty = F.concat("extracted_text", F.lit("\x01x\U0001f600\x0b"))
    return table(spark, sf_dir, "ocr_results").select("id", F.md5(text.xml_safe(dirty)).alias("digest"))


#: RE2 has no look-around: both ends are matched and put back, twice as matches may share one.
_JOINED = r"(^|[^\p{L}\p{N}_])([A-Za-z]+)-\s*\n\s*([a-z][A-Za-z]*)($|[^\p{L}\p{N}_])"
_ONCE = lambda c: f"regexp_replace({c}, '{_JOINED}', '\\1\\2\\3\\4', 'g')"
_DEHYPHEN = lambda c: _ONCE(_ONCE(c))


@query(f"SELECT id, length(extracted_text) - length({_DEHYPHEN('extracted_text')}) AS removed, md5({_DEHYPHEN('extracted_text')}) AS digest FROM ocr_results")
def dehyphenate(spark, sf_dir):
    t = text.dehyphenate(F.col("extracted_text"))
    return table(spark, sf_dir, "ocr_results").select("id", (F.length("extracted_text") - F.length(t)).cast("bigint").alias("removed"), F.md5(t).alias("digest"))


@query(f"""SELECT id, array_to_string(list_filter(list_transform(string_split_regex(extracted_text, '\n[ \t]*\n'),
    lambda p: {_STRIP(f"regexp_replace({_DEHYPHEN('p')}, '[{_S}]*\n[{_S}]*', ' ', 'g')")}), lambda p: p <> ''), chr(10) || chr(10)) AS reflowed FROM ocr_results""")
def reflow(spark, sf_dir):
    return table(spark, sf_dir, "ocr_results").select("id", text.reflow(F.col("extracted_text")).alias("reflowed"))


@query(f"SELECT doc_id, greatest(1, floor(len(regexp_extract_all(text, '[^{_S}]+')) * 4 / 3))::INT AS tokens FROM documents")
def token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("text").isNotNull(), text.token_estimate(F.col("text"))).alias("tokens")).withColumn("tokens", F.coalesce("tokens", F.lit(1)))


@query("""SELECT suite, lang, count(*) AS items, sum(len(regexp_extract_all(lower(text), '[a-z0-9'']+')))::BIGINT AS tokens FROM eval_items GROUP BY 1, 2""")
def eval_tokens(spark, sf_dir):
    return table(spark, sf_dir, "eval_items").groupBy("suite", "lang").agg(F.count("*").alias("items"), F.sum(F.size(text.tokens(F.col("text")))).alias("tokens"))


@query("""SELECT doc_id, CASE lower(lang) WHEN 'fr' THEN 'en,fr' WHEN 'de' THEN 'en,de' WHEN 'es' THEN 'en,es' WHEN 'pt' THEN 'en,pt' WHEN 'ar' THEN 'en,ar'
    WHEN 'zh' THEN 'en,ch_sim' WHEN 'zh-cn' THEN 'en,ch_sim' WHEN 'zh-tw' THEN 'en,ch_tra' ELSE 'en' END AS models FROM documents""")
def engine_langs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(text.models_for(F.col("lang")), ",").alias("models"))


_FORMULA = (
    "CASE p_partkey % 5 WHEN 0 THEN concat('x = ', cast(p_size as string), ' + y^2') WHEN 1 THEN concat('f(x) = sin(x) + ', cast(p_size as string), '/4') "
    "WHEN 2 THEN concat('alpha + beta <= ', cast(p_size as string), ' times sqrt(pi)') WHEN 3 THEN p_name ELSE concat('E = m_', cast(p_size as string), '0^12 <-> ', p_brand) END"
)


def _formula_sql(c: str) -> str:
    t = _STRIP(c)
    many = f"len(regexp_extract_all({t}, '{text.MATH_MARK}')) >= 3 AND len(regexp_extract_all({t}, '[^{_S}]+')) <= 15"
    return f"({t} <> '' AND ({many} OR regexp_matches({t}, '{text.FUNCTION_OF}') OR (regexp_matches({t}, '{text.ASSIGNMENT}') AND regexp_matches({t}, '[+\\-*/^]'))))"


def _latex_sql(c: str) -> str:
    t = f"regexp_replace({_STRIP(c)}, '([A-Za-z0-9_^]+)\\s*/\\s*([A-Za-z0-9_^]+)', '\\\\frac{{\\1}}{{\\2}}', 'g')"
    t = f"regexp_replace({t}, 'sqrt\\s*\\((.*?)\\)', '\\\\sqrt{{\\1}}', 'g')"
    for g in text.GREEK:
        t = f"regexp_replace({t}, '\\b{g}\\b', '\\\\{g}', 'g')"
    for a, b in text.OPERATORS:
        t = f"regexp_replace({t}, '\\b{a}\\b', '\\\\{b}', 'g')" if a.isalpha() else f"replace({t}, '{a}', '\\{b}')"
    t = f"regexp_replace({t}, '\\^([A-Za-z0-9]{{2,}})', '^{{\\1}}', 'g')"
    return f"regexp_replace({t}, '_([A-Za-z0-9]{{2,}})', '_{{\\1}}', 'g')"


@query(f"SELECT p_partkey, {_formula_sql(_FORMULA)} AS is_formula, {_latex_sql(_FORMULA)} AS latex FROM part")
def formulas(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.expr(_FORMULA).alias("t"))
    return p.select("p_partkey", text.is_formula(F.col("t")).alias("is_formula"), text.to_latex(F.col("t")).alias("latex"))


@query("""SELECT p_partkey, concat('We set ', '$x = ', p_size, '$ and keep ', '$y = ', p_size, 'z', '$.') AS t FROM part""")
def inline_math(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("We set x = "), F.col("p_size").cast("string"), F.lit(" and keep y = "), F.col("p_size").cast("string"), F.lit("z.")).alias("t"))
    return p.select("p_partkey", text.inline_math(F.col("t")).alias("t"))


@query("""SELECT id, CASE WHEN regexp_matches(regexp_replace(f, '^\\s+', ''), '^[=+\\-@]') OR regexp_matches(f, '^[\\t\\r]') THEN '''' || f ELSE f END AS filename FROM
    (SELECT id, CASE WHEN id % 3 = 0 THEN '=' || filename WHEN id % 3 = 1 THEN '  -' || filename ELSE filename END AS f FROM ocr_jobs)""")
def csv_guard(spark, sf_dir):
    f = F.when(F.col("id") % 3 == 0, F.concat(F.lit("="), "filename")).when(F.col("id") % 3 == 1, F.concat(F.lit("  -"), "filename")).otherwise(F.col("filename"))
    return table(spark, sf_dir, "ocr_jobs").select("id", text.csv_guard(f).alias("filename"))


@query("""SELECT doc_id, concat('---', chr(10), array_to_string(list_filter([ 'lang: ' || lang, 'pages: ' || page_count, 'source: ' || source, 'title: ' || title], lambda x: x IS NOT NULL), chr(10)), chr(10), '---', chr(10)) AS header FROM documents""")
def front_matter(spark, sf_dir):
    m = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k).alias("key"), F.col(c).cast("string").alias("value")) for k, c in (("title", "title"), ("source", "source"), ("lang", "lang"), ("pages", "page_count"))]), lambda e: e["value"].isNotNull()))
    return table(spark, sf_dir, "documents").select("doc_id", text.front_matter(m).alias("header"))


@query("""SELECT s.doc_id, md5(s.text) AS digest, count(*) OVER (PARTITION BY s.text) AS copies FROM documents s WHERE s.text IS NOT NULL QUALIFY copies > 1""")
def duplicate_content(spark, sf_dir):
    """Documents with a twin: counts by hash first, so that texts aren't shuffled in groups."""
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("h"), F.md5("text").alias("digest"))
    n = d.groupBy("h").agg(F.count("*").alias("copies")).where("copies > 1")
    return d.join(n, "h").select("doc_id", "digest", "copies")
