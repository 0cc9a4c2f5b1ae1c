"""Files written and read back: the text that comes back is what SQL makes of the table."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliospark.arrow import map_batches
from foliospark.functions import chars, text
from foliospark.session import table
from foliospark.sources import containers

from .registry import query

_S = chars.SPACE
_STRIP = lambda c: f"regexp_replace({c}, '^[{_S}]+|[{_S}]+$', '', 'g')"
_SAFE = f"regexp_replace(text, '{text.NOT_XML}', '', 'g')"
_TABLE = "(regexp_matches(x, '^\\s*\\|') AND regexp_matches(x, '\\|\\s*$'))"


@query(f"""SELECT doc_id, md5(array_to_string(list_transform(list_filter(string_split({_SAFE}, chr(10)), lambda x: NOT regexp_matches(x, '^\\s*\\|[ :|-]+\\|\\s*$')), lambda x: x), chr(10))) AS digest, length({_SAFE}) AS chars
    FROM documents WHERE text IS NOT NULL AND NOT regexp_matches(text, '(^|\\n)\\s*\\||\\r|(^|\\n)(---|#{{4,}})')""")
def docx_round_trip(spark, sf_dir):
    """Documents without tables and page breaks, written as Word files and read back."""
    d = table(spark, sf_dir, "documents").where("text is not null").where(~F.col("text").rlike(r"(^|\n)\s*\||\r|(^|\n)(---|#{4,})"))
    files = containers.packed(d.withColumn("title", F.coalesce("title", F.lit(""))), "doc_id", "bigint", "title text", containers.docx)
    back = map_batches(files, lambda: lambda ids, data: [(i, containers.docx_text(x)) for i, x in zip(ids, data)], "doc_id bigint, text string")
    return back.select("doc_id", F.md5("text").alias("digest"), F.length("text").alias("chars").cast("bigint").alias("chars"))


@query(f"""SELECT doc_id, 1 AS chapters, md5(array_to_string(list_filter(list_transform(string_split_regex({_SAFE}, '\n[ \t]*\n'), lambda x: {_STRIP(f"regexp_replace(x, '[{_S}]+', ' ', 'g')")}), lambda x: x <> ''), chr(10) || chr(10))) AS digest
    FROM documents WHERE text IS NOT NULL AND title IS NOT NULL""")
def epub_round_trip(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null and title is not null")
    files = containers.packed(d, "doc_id", "bigint", "title text", lambda title, body: containers.epub(title, [(title, body)]))
    back = map_batches(files, lambda: lambda ids, data: [(i, len(c := containers.epub_chapters(x)), c[0][1]) for i, x in zip(ids, data)], "doc_id bigint, chapters int, text string")
    return back.select("doc_id", "chapters", F.md5("text").alias("digest"))


_LINE = f"list_filter(list_transform(string_split(regexp_replace(extracted_text, '[^ -~\\n]', '?', 'g'), chr(10)), lambda x: {_STRIP('x')}), lambda x: x <> '')"


@query(f"""SELECT id, 1 AS pages, md5(array_to_string({_LINE}, chr(10))) AS digest FROM ocr_results WHERE extracted_text IS NOT NULL AND regexp_matches(extracted_text, '\\S')""")
def searchable_pdfs(spark, sf_dir):
    """Pages as PDF files with invisible text in the boxes of their lines; the native text that
    is read from them is the page's, line by line (in ASCII)."""
    from foliospark.sources import sinks

    flat = F.regexp_replace("extracted_text", r"[^ -~\n]", "?")
    p = table(spark, sf_dir, "ocr_results").where(F.col("extracted_text").rlike(r"\S")).select(F.col("id").alias("page_id"), F.lit(800.0).alias("width"), F.lit(1000.0).alias("height"), flat.alias("text"))
    boxes = sinks.text_boxes(p).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("ord", "line", "xmin", "baseline", "font_size"))).alias("boxes"))
    pdf = lambda rows: containers.searchable_pdf([(800.0, 1000.0, [(b["line"], b["xmin"], b["baseline"], b["font_size"]) for b in rows])])
    files = containers.packed(boxes, "page_id", "bigint", "boxes", pdf)
    pages = containers.native_pages(files.select(F.col("page_id").cast("string").alias("path"), F.col("data").alias("content")))
    return pages.groupBy(F.col("path").cast("bigint").alias("id")).agg(F.count("page").cast("int").alias("pages"), F.md5(F.first("text")).alias("digest"))


@query("SELECT id::VARCHAR AS path, f AS first, least(f + 9, page_count)::INT AS last FROM (SELECT id, page_count, unnest(range(1, page_count + 1, 10))::INT AS f FROM ocr_jobs WHERE page_count >= 1)")
def page_batches(spark, sf_dir):
    return containers.page_ranges(table(spark, sf_dir, "ocr_jobs").select(F.col("id").cast("string").alias("path"), F.col("page_count").alias("pages")))
