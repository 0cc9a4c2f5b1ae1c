"""Exports, filters and small reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliospark.functions import chars, text
from foliospark.operators import ledger
from foliospark.session import table
from foliospark.sources import sinks

from .registry import query

_S = chars.SPACE
_STRIP = lambda c: f"regexp_replace({c}, '^[{_S}]+|[{_S}]+$', '', 'g')"
_HTML = lambda c: f"replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
_ONCE = lambda c: f"regexp_replace({c}, '(^|[^\\p{{L}}\\p{{N}}_])([A-Za-z]+)-\\s*\\n\\s*([a-z][A-Za-z]*)($|[^\\p{{L}}\\p{{N}}_])', '\\1\\2\\3\\4', 'g')"


@query("SELECT id, job_id, confidence_score FROM ocr_results WHERE confidence_score < 0.85")
def low_confidence(spark, sf_dir):
    return table(spark, sf_dir, "ocr_results").where("confidence_score < 0.85").select("id", "job_id", "confidence_score")


@query("SELECT engine, count(*) AS kept, min(confidence) AS least FROM page_results WHERE confidence >= 0.5 AND text IS NOT NULL AND trim(text) <> '' GROUP BY 1")
def kept_detections(spark, sf_dir):
    p = table(spark, sf_dir, "page_results").where((F.col("confidence") >= 0.5) & F.col("text").isNotNull() & (F.trim("text") != ""))
    return p.groupBy("engine").agg(F.count("*").alias("kept"), F.min("confidence").alias("least"))


@query("SELECT id, CASE WHEN length(extracted_text) > 1000 THEN substr(extracted_text, 1, 1000) || '...' ELSE extracted_text END AS excerpt FROM ocr_results")
def excerpts(spark, sf_dir):
    """What a list shows of a page: the first thousand characters."""
    t = F.col("extracted_text")
    return table(spark, sf_dir, "ocr_results").select("id", F.when(F.length(t) > 1000, F.concat(F.substring(t, 1, 1000), F.lit("..."))).otherwise(t).alias("excerpt"))


_CLASS = (("rule", "^[ ]*\\|[ :|-]+\\|[ ]*$"), ("row", "^[ ]*\\|.*\\|[ ]*$"), ("heading_3", "^### "), ("heading_2", "^## "), ("heading_1", "^# "), ("break", "^---[ ]*$"))


@query(f"""SELECT kind, count(*) AS lines FROM (SELECT CASE {' '.join(f"WHEN regexp_matches(x, '{p}') THEN '{k}'" for k, p in _CLASS)} WHEN trim(x) = '' THEN 'blank' ELSE 'text' END AS kind
    FROM (SELECT unnest(string_split(extracted_text, chr(10))) AS x FROM ocr_results WHERE extracted_text IS NOT NULL)) GROUP BY 1""")
def markdown_lines(spark, sf_dir):
    """Lines by the part of a document that they become."""
    x = table(spark, sf_dir, "ocr_results").where("extracted_text is not null").select(F.explode(F.split("extracted_text", "\n", -1)).alias("x"))
    kind = F.when(F.trim("x") == "", "blank").otherwise("text")
    for name, pattern in reversed(_CLASS):
        kind = F.when(F.col("x").rlike(pattern), name).otherwise(kind)
    return x.groupBy(kind.alias("kind")).agg(F.count("*").alias("lines"))


@query(f"""SELECT doc_id, len(p) AS paragraphs, len(list_filter(p, lambda x: starts_with(x, '# ') OR starts_with(x, '## '))) AS headings FROM (
    SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\n[ \t]*\n'), lambda x: {_STRIP('x')}), lambda x: x <> '') AS p FROM documents WHERE text IS NOT NULL)""")
def book_paragraph_counts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.filter(F.transform(F.split("text", "\n[ \t]*\n", -1), chars.strip), lambda x: x != "").alias("p"))
    heads = F.filter("p", lambda x: x.startswith("# ") | x.startswith("## "))
    return d.select("doc_id", F.size("p").cast("bigint").alias("paragraphs"), F.size(heads).cast("bigint").alias("headings"))


_IN = lambda k: ", ".join(f"'{w}'" for w in text.LANGUAGE_WORDS[k])
_LANGS = list(text.LANGUAGE_WORDS)


@query(f"""SELECT doc_id, CASE WHEN m = 0 THEN 'en' {' '.join(f"WHEN {k}_ = m THEN '{k}'" for k in _LANGS)} END AS detected FROM (SELECT *, greatest({', '.join(f'{k}_' for k in _LANGS)}) AS m FROM (
    SELECT doc_id, {', '.join(f"len(list_filter(w, lambda x: x IN ({_IN(k)}))) AS {k}_" for k in _LANGS)} FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '\\p{{L}}+') AS w FROM documents)))""")
def detect_language(spark, sf_dir):
    """Language by its commonest words; English where none is found."""
    return table(spark, sf_dir, "documents").select("doc_id", text.language(F.col("text")).alias("detected"))


@query("SELECT job_id, count(*) FILTER (WHERE error IS NOT NULL) AS failed, count(*) FILTER (WHERE error IS NULL) AS passed, bool_and(error IS NULL OR text IS NULL) AS isolated FROM page_results GROUP BY 1")
def fault_isolation(spark, sf_dir):
    """Failed attempts of a job hold no text and leave the others alone."""
    bad = F.col("error").isNotNull()
    return table(spark, sf_dir, "page_results").groupBy("job_id").agg(F.count_if(bad).alias("failed"), F.count_if(~bad).alias("passed"), F.bool_and(~bad | F.col("text").isNull()).alias("isolated"))


@query("SELECT job_id, round(avg(c) + 1e-9, 4) AS mean_confidence FROM (SELECT job_id, page, avg(confidence) AS c FROM page_results GROUP BY 1, 2) GROUP BY 1")
def mean_of_means(spark, sf_dir):
    p = table(spark, sf_dir, "page_results").groupBy("job_id", "page").agg(F.avg("confidence").alias("c"))
    return p.groupBy("job_id").agg(ledger.rounded(F.avg("c")).alias("mean_confidence"))


@query("SELECT id, filename, coalesce(dlq_reason, error_message) AS reason FROM ocr_jobs WHERE dlq_at IS NOT NULL OR error_message IS NOT NULL ORDER BY coalesce(dlq_at, completed_at, created_at) DESC NULLS LAST, id LIMIT 100")
def dead_letters(spark, sf_dir):
    """The newest hundred jobs that were given up or left an error: a top-k report."""
    lost = table(spark, sf_dir, "ocr_jobs").where("dlq_at is not null or error_message is not null")
    return lost.orderBy(F.coalesce("dlq_at", "completed_at", "created_at").desc_nulls_last(), "id").limit(100).select("id", "filename", F.coalesce("dlq_reason", "error_message").alias("reason"))


@query("""SELECT id, ratio, (ceil(48 * greatest(ratio, 48.0 / 320) / 32) * 32)::INT AS padded FROM (SELECT id, round(greatest(1, length(extracted_text))::DOUBLE / 40, 6) AS ratio FROM ocr_results WHERE extracted_text IS NOT NULL)""")
def padded_widths(spark, sf_dir):
    """Width of a recognition crop of height 48 by aspect, in steps of 32."""
    r = table(spark, sf_dir, "ocr_results").where("extracted_text is not null").select("id", F.round(F.greatest(F.lit(1), F.length("extracted_text")) / 40.0, 6).alias("ratio"))
    return r.select("id", "ratio", (F.ceil(F.lit(48) * F.greatest("ratio", F.lit(48.0 / 320)) / 32) * 32).cast("int").alias("padded"))


@query(f"""WITH h AS (SELECT job_id, coalesce(page, -1) AS page, route, confidence, sha256(concat_ws(chr(31), page::VARCHAR, coalesce(route, ''), coalesce(text, '\\0'))) AS h FROM page_results),
    p AS (SELECT job_id, floor(page / {sinks.MANIFEST_PART}) AS part, count(*) AS n, count(*) FILTER (WHERE route = 'native') AS a, count(*) FILTER (WHERE route <> 'native') AS b,
      sum(confidence) AS s, count(confidence) AS c, sha256(string_agg(h, chr(10) ORDER BY page, h)) AS h FROM h GROUP BY 1, 2)
    SELECT job_id, sum(n)::BIGINT AS pages, sum(a)::BIGINT AS native_pages, sum(b)::BIGINT AS ocr_pages, round(sum(s) / nullif(sum(c), 0) + 1e-9, 4) AS mean_confidence,
      sha256(string_agg(h, chr(10) ORDER BY part, h)) AS digest FROM p GROUP BY 1""")
def manifests(spark, sf_dir):
    return sinks.manifest(table(spark, sf_dir, "page_results"))


@query(f"""SELECT id, k - 1 AS ord, line, round((1000.0::DOUBLE / (n + 2)) * k, 6) AS ymin, round((1000.0::DOUBLE / (n + 2)) * (k + 1), 6) AS ymax FROM (
    SELECT id, len(l) AS n, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS k FROM (
      SELECT id, list_filter(list_transform(string_split(extracted_text, chr(10)), lambda x: {_STRIP('x')}), lambda x: x <> '') AS l FROM ocr_results WHERE extracted_text IS NOT NULL))""")
def text_boxes(spark, sf_dir):
    p = table(spark, sf_dir, "ocr_results").where("extracted_text is not null").select(F.col("id").alias("page_id"), F.lit(800.0).alias("width"), F.lit(1000.0).alias("height"), F.col("extracted_text").alias("text"))
    return sinks.text_boxes(p).select(F.col("page_id").alias("id"), F.col("ord").cast("bigint").alias("ord"), "line", F.round("ymin", 6).alias("ymin"), F.round("ymax", 6).alias("ymax"))


@query(f"""SELECT id, '<section id="page_' || page_number || '"><h2>Page ' || page_number || '</h2>' || array_to_string(list_transform(p, lambda x: '<p>' || {_HTML('x')} || '</p>'), '') || '</section>' AS section FROM (
    SELECT id, page_number, extracted_text, list_filter(list_transform(string_split_regex(extracted_text, '\n[ \t]*\n'), lambda x: {_STRIP(f"regexp_replace({_ONCE(_ONCE('x'))}, '[{_S}]*\n[{_S}]*', ' ', 'g')")}), lambda x: x <> '') AS p
    FROM ocr_results WHERE page_number IS NOT NULL AND {_STRIP('extracted_text')} <> '')""")
def xhtml_sections(spark, sf_dir):
    p = table(spark, sf_dir, "ocr_results").where("page_number is not null").select(F.col("id").alias("doc"), F.col("page_number").alias("page"), F.lit("x").alias("title"), F.col("extracted_text").alias("text"))
    return sinks.xhtml(p).select(F.col("doc").alias("id"), "section")


@query("SELECT doc_id, text AS page_content, map_extract(map {'title': title}, 'title')[1] AS title FROM documents")
def loader_documents(spark, sf_dir):
    d = sinks.loader_documents(table(spark, sf_dir, "documents").select("doc_id", "title", "lang", "source", "text"))
    return d.select(F.col("metadata")["doc_id"].cast("bigint").alias("doc_id"), "page_content", F.col("metadata")["title"].alias("title"))


@query(f"""SELECT job_id, chapter_number AS chapter, '<h2>' || {_HTML("coalesce(max(chapter_title), '')")} || '</h2>' || coalesce(string_agg('<p>' || {_HTML('text')} || '</p>', '' ORDER BY para_no, para_id) FILTER (WHERE NOT is_heading), '') AS html
    FROM book_paragraphs WHERE job_id IS NOT NULL AND text IS NOT NULL GROUP BY 1, 2""")
def chapter_pages(spark, sf_dir):
    """Every chapter of every book as HTML."""
    b = table(spark, sf_dir, "book_paragraphs").where("job_id is not null and text is not null")
    paras = F.transform(F.array_sort(F.collect_list(F.when(~F.col("is_heading"), F.struct("para_no", "para_id", "text")))), lambda x: x["text"])
    g = b.groupBy("job_id", F.col("chapter_number").alias("chapter")).agg(F.coalesce(F.max("chapter_title"), F.lit("")).alias("t"), paras.alias("p"))
    return g.select("job_id", "chapter", sinks.chapter_html(F.col("t"), F.lit(1), F.col("p")).alias("html"))


@query(f"""WITH t AS (SELECT doc_id, title, {_STRIP("coalesce(title, '')")} <> '' AS ok, {_STRIP('title')} AS line FROM documents)
    SELECT doc_id AS page_id, title AS line, 'model' AS origin, 1.0::DOUBLE AS xmin, 3.0::DOUBLE AS xmax, 4.0::DOUBLE AS ymax FROM t WHERE ok AND doc_id % 3 = 0
    UNION ALL SELECT doc_id, title, 'detections', 0.0, (doc_id % 100 + 1)::DOUBLE, 9.0 FROM t WHERE ok AND doc_id % 3 = 1
    UNION ALL SELECT doc_id, line, 'lines', 5.0, 95.0, round(200.0 / 3, 4)::DOUBLE FROM t WHERE ok AND doc_id % 3 = 2""")
def page_boxes(spark, sf_dir):
    """Titles as boxes: of every third document from a page model, of the next from detections
    with four corners, of the rest spread over the page."""
    d, third = table(spark, sf_dir, "documents"), F.col("doc_id") % 3
    own = [F.col("doc_id").alias("page_id"), F.lit(0).alias("ord"), F.col("title").alias("line")]
    model = d.where(third == 0).select(*own, *[F.lit(float(v)).alias(k) for k, v in (("xmin", 1), ("ymin", 2), ("xmax", 3), ("ymax", 4))])
    right = (F.col("doc_id") % 100 + 1).cast("double")
    quad = F.array(F.lit(0.0), F.lit(0.0), right, F.lit(1.0), right, F.lit(9.0), F.lit(0.0), F.lit(8.0))
    raw = d.select(F.col("doc_id").alias("page_id"), F.lit(100.0).alias("width"), F.lit(100.0).alias("height"), F.col("title").alias("text"))
    b = sinks.best_boxes(model, d.where(third == 1).select(*own, quad.alias("coords")), raw)
    return b.select("page_id", "line", "origin", "xmin", "xmax", F.round("ymax", 4).alias("ymax"))


@query(f"""SELECT doc_id AS page_id, '<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 100 200"><rect x="0" y="10" width="' || least(100, doc_id % 150) || '" height="50" fill="none" stroke="#b45309"/><text x="0" y="10">'
    || {_HTML(f"left(regexp_replace(regexp_replace(title, '{text.NOT_XML}', '', 'g'), '\\s+', ' ', 'g'), 40)")} || '</text></svg>' AS svg FROM documents WHERE title IS NOT NULL""")
def page_drawings(spark, sf_dir):
    """One block a page, wider than the page on both sides for some."""
    d = table(spark, sf_dir, "documents").where("title is not null")
    return sinks.layout_svg(d.select(
        F.col("doc_id").alias("page_id"), F.lit(100).alias("width"), F.lit(200).alias("height"), F.lit(0).alias("reading_order"), F.col("title").alias("text"), F.lit("title").alias("kind"),
        F.lit(-5.0).alias("xmin"), F.lit(10.0).alias("ymin"), (F.col("doc_id") % 150).cast("double").alias("xmax"), F.lit(60.0).alias("ymax"),
    ))


@query(f"""SELECT doc_id, k - 1 AS place, CASE WHEN starts_with(p, '## ') THEN 2 WHEN starts_with(p, '# ') THEN 1 ELSE 0 END AS level, md5({_STRIP("regexp_replace(p, '^#{1,2} ', '')")}) AS digest FROM (
    SELECT doc_id, unnest(l) AS p, unnest(range(1, len(l) + 1)) AS k FROM (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\n[ \t]*\n'), lambda x: {_STRIP('x')}), lambda x: x <> '') AS l FROM documents WHERE text IS NOT NULL))""")
def book_paragraph_rows(spark, sf_dir):
    """Paragraphs and headings of every document in order."""
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.posexplode(text.paragraphs(F.col("text"))).alias("place", "p"))
    return d.select("doc_id", F.col("place").cast("bigint").alias("place"), F.coalesce("p.level", F.lit(0)).alias("level"), F.md5("p.text").alias("digest"))


@query(f"""SELECT id, CASE WHEN id % 2 = 0 THEN array_to_string(list_filter(list_transform(string_split_regex(extracted_text, '\n[ \t]*\n'), lambda x: {_STRIP(f"regexp_replace({_ONCE(_ONCE('x'))}, '[{_S}]*\n[{_S}]*', ' ', 'g')")}), lambda x: x <> ''), chr(10) || chr(10)) ELSE extracted_text END AS text,
    confidence_score AS confidence FROM ocr_results WHERE {_STRIP('extracted_text')} <> ''""")
def reflowed_blocks(spark, sf_dir):
    """Every other page as a block of text, the rest as tables, whose lines stay."""
    r = table(spark, sf_dir, "ocr_results").where(chars.strip(F.col("extracted_text")) != "")
    lines = F.transform(F.split("extracted_text", "\n", -1), lambda x: F.struct(x.alias("text"), F.col("confidence_score").alias("confidence")))
    kind = F.when(F.col("id") % 2 == 0, "text").otherwise("table")
    return r.select("id", text.reflow_block(kind, lines).alias("b")).select("id", "b.text", "b.confidence")
