"""The ``pN_`` queries. Each reads its whole tables from ``sf_dir``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.session import table

from . import boilerplate, encoding, leakage, mixing, quantiles, repetition, scannoise, splitting, subjects, textstats


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetitive(repetition.repetition(table(spark, sf_dir, "ocr_results"))).select("result_id")


def p1_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repeated share of every page beside the recorded ratio."""
    recorded = table(spark, sf_dir, "native_text_quality").groupBy("result_id").agg(F.max("duplicate_ratio").alias("recorded_duplicate_ratio"))
    return repetition.repetition(table(spark, sf_dir, "ocr_results")).join(recorded, "result_id", "left")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textstats.page_kinds(table(spark, sf_dir, "ocr_results")).where("kind <> 'prose'").select("result_id", "kind")


def p2_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics, scores and kind of every page beside the recorded ratios."""
    recorded = table(spark, sf_dir, "native_text_quality").groupBy("result_id").agg(
        *[F.max(c).alias(f"recorded_{c}") for c in ("printable_ratio", "alphanumeric_ratio", "whitespace_sanity")]
    )
    return textstats.page_kinds(table(spark, sf_dir, "ocr_results")).join(recorded, "result_id", "left")


def _split(spark: SparkSession, sf_dir: str, with_text: bool) -> DataFrame:
    return splitting.split_all(
        table(spark, sf_dir, "split_limits"),
        {
            "ocr_results": (table(spark, sf_dir, "ocr_results"), "id", "extracted_text"),
            "book_paragraphs": (table(spark, sf_dir, "book_paragraphs"), "para_id", "text"),
        },
        with_text,
    )


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir, False).where("piece_no = 1").select("item_kind", "item_id")


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir, True)


def _scans(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    return [table(spark, sf_dir, x) for x in ("ocr_results", "page_results", "ocr_jobs", "book_paragraphs", "gold")]


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scannoise.noise(*_scans(spark, sf_dir)).select("table_name", "job_id", "page", "kind")


def p4_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scannoise.repair(*_scans(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.wrongly_decoded(table(spark, sf_dir, "ocr_results")).select(F.col("result_id"))


def p5_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.wrongly_decoded(table(spark, sf_dir, "ocr_results"), with_text=True)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate.lines_of(p6_sequences(spark, sf_dir)).select(F.col("source").alias("job_id"), "line")


def p6_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate.sequences(table(spark, sf_dir, "ocr_results"))


def p6_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate.cleaned(table(spark, sf_dir, "ocr_results"), p6_sequences(spark, sf_dir))


def p7_job_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = quantiles.summaries(table(spark, sf_dir, "ocr_results"), ["job_id"], "processing_time")
    return quantiles.percentiles(s, ["job_id"])


def p7_job_percentiles_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from summaries of separate days."""
    pages = table(spark, sf_dir, "ocr_results").withColumn("day", F.to_date("created_at"))
    days = quantiles.summaries(pages, ["job_id", "day"], "processing_time")
    return quantiles.percentiles(quantiles.combine(days, ["job_id"]), ["job_id"])


def p7_metric_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = quantiles.summaries(table(spark, sf_dir, "ocr_metrics"), ["job_id"], "avg_page_time")
    return quantiles.percentiles(s, ["job_id"])


def p7_metric_percentiles_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from summaries of separate days."""
    metrics = table(spark, sf_dir, "ocr_metrics").withColumn("day", F.to_date("timestamp"))
    days = quantiles.summaries(metrics, ["job_id", "day"], "avg_page_time")
    return quantiles.percentiles(quantiles.combine(days, ["job_id"]), ["job_id"])


def p7_job_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries coarse enough to compress jobs of forty pages, held against all values."""
    return quantiles.within(table(spark, sf_dir, "ocr_results").where("job_id is not null"), ["job_id"], "processing_time", 0.1)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(table(spark, sf_dir, "eval_items"), table(spark, sf_dir, "documents")).select("item_id", "doc_id")


def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked_items(leakage.leaks(table(spark, sf_dir, "eval_items"), table(spark, sf_dir, "documents")))


def p9_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.select(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(p9_selection(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the labels name subjects; only those of the table of subjects count
    labels, known = table(spark, sf_dir, "subject_labels"), table(spark, sf_dir, "subjects").select("subject")
    labels = labels.join(known, "subject", "left_semi").unionByName(labels.where("subject = 'none'"))
    return subjects.assign(table(spark, sf_dir, "documents"), labels)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assigned(spark, sf_dir).select("doc_id", "subject")


def p10_makeup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.makeup(table(spark, sf_dir, "documents"), _assigned(spark, sf_dir))


QUERIES = {k: v for k, v in list(globals().items()) if k[0] == "p" and k[1].isdigit()}


def _rank_sql(name: str, value: str) -> str:
    pick = ", ".join(f"max(v) FILTER (WHERE r = greatest(1, CAST(ceil({q} * n) AS BIGINT))) AS p{round(q * 100):d}" for q in (0.5, 0.9, 0.99))
    return f"""
        WITH m AS (SELECT job_id, {value} AS v FROM {name} WHERE {value} IS NOT NULL AND NOT isnan({value}) AND {value} >= 0),
        k AS (SELECT job_id, v, row_number() OVER (PARTITION BY job_id ORDER BY v) AS r, count(*) OVER (PARTITION BY job_id) AS n FROM m)
        SELECT job_id, max(n) AS n, CAST(0 AS BIGINT) AS rank_error, {pick} FROM k GROUP BY job_id"""


_FORM = lambda x: f"trim(regexp_replace(regexp_replace(lower({x}), '[0-9]+', '#', 'g'), '[^a-zà-öø-ÿœ#]+', ' ', 'g'))"
_FREQUENT = f"""
        WITH p AS (SELECT job_id, page_number, extracted_text AS t FROM ocr_results
                   WHERE job_id IS NOT NULL AND page_number IS NOT NULL AND regexp_matches(extracted_text, '\\S')),
        l AS (SELECT DISTINCT job_id, page_number, {_FORM('x')} AS line FROM (SELECT job_id, page_number, unnest(string_split(t, chr(10))) AS x FROM p)),
        n AS (SELECT job_id, count(DISTINCT page_number) AS pages FROM p GROUP BY 1)
        SELECT job_id, line FROM (
          SELECT l.job_id, line, count(*) AS c, any_value(n.pages) AS pages FROM l JOIN n ON l.job_id = n.job_id
          WHERE regexp_matches(line, '[a-zà-öø-ÿœ]') GROUP BY 1, 2)
        WHERE c >= 8 AND c >= 0.2 * pages"""

ORACLES: dict[str, str] = {
    "p3_found": """
        SELECT 'ocr_results' AS item_kind, id AS item_id FROM ocr_results
        WHERE length(extracted_text) > (SELECT max_chars FROM split_limits WHERE item_kind = 'ocr_results')
        UNION ALL
        SELECT 'book_paragraphs', para_id FROM book_paragraphs
        WHERE length(text) > (SELECT max_chars FROM split_limits WHERE item_kind = 'book_paragraphs')""",
    "p6_found": f"SELECT job_id, line FROM ({_FREQUENT})",
    "p6_cleaned": f"""
        WITH f AS (SELECT job_id, list(line) AS frequent FROM ({_FREQUENT}) GROUP BY 1),
        r AS (SELECT id, ocr_results.job_id AS source, extracted_text AS t, frequent, string_split(extracted_text, chr(10)) AS l
              FROM ocr_results LEFT JOIN f ON ocr_results.job_id = f.job_id),
        k AS (SELECT *, list_filter(l, lambda x: NOT list_contains(frequent, {_FORM('x')})) AS kept FROM r)
        SELECT id, source, CASE WHEN frequent IS NULL THEN t ELSE array_to_string(kept, chr(10)) END AS cleaned_text,
          CASE WHEN frequent IS NULL OR t IS NULL THEN 0 ELSE len(l) - len(kept) END::INT AS removed_lines FROM k""",
    # within the permitted error a group of so few values keeps every rank
    "p7_job_percentiles": _rank_sql("ocr_results", "processing_time"),
    "p7_job_percentiles_by_day": _rank_sql("ocr_results", "processing_time"),
    # every percentile of a compressed summary must hold within its own bound
    "p7_job_bounds": """SELECT job_id, count(*) AS n, true AS p50_within, true AS p90_within, true AS p99_within, true AS error_within FROM ocr_results
        WHERE job_id IS NOT NULL AND processing_time IS NOT NULL AND NOT isnan(processing_time) AND processing_time >= 0 GROUP BY 1""",
    "p7_metric_percentiles": _rank_sql("ocr_metrics", "avg_page_time"),
    "p7_metric_percentiles_by_day": _rank_sql("ocr_metrics", "avg_page_time"),
}
