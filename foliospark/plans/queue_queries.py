"""Queries over the data side of the job queue."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliospark.operators import ledger, queue
from foliospark.session import table

from .registry import query

_NOW = "2025-06-01 00:00:00"
_OK = lambda c: f"CASE WHEN {c} IS NOT NULL AND NOT isnan({c}) AND {c} >= 0 THEN {c} END"


def _now():
    return F.lit(_NOW).cast("timestamp")


@query("SELECT DISTINCT regexp_replace(regexp_replace(lower(trim(status)), '[\\s-]+', '_', 'g'), '[^a-z0-9_]', '', 'g') AS status FROM ocr_jobs WHERE status IS NOT NULL")
def status_options(spark, sf_dir):
    from foliospark.functions.text import status_key

    return table(spark, sf_dir, "ocr_jobs").where("status is not null").select(status_key(F.col("status")).alias("status")).distinct()


@query("""SELECT id, row_number() OVER (ORDER BY CASE lower(priority) WHEN 'high' THEN 0 WHEN 'low' THEN 2 ELSE 1 END, coalesce(created_at, TIMESTAMPTZ '1970-01-01 00:00:00+00'), id) AS place
    FROM ocr_jobs WHERE completed_at IS NULL""")
def dequeue_order(spark, sf_dir):
    jobs = table(spark, sf_dir, "ocr_jobs").where("completed_at is null")
    return queue.dequeue_order(jobs, "priority", "created_at", "id").select("id", "place")


@query(f"SELECT id FROM ocr_jobs WHERE started_at IS NOT NULL AND started_at + INTERVAL 30 DAY <= TIMESTAMPTZ '{_NOW}+00'")
def matured_jobs(spark, sf_dir):
    jobs = table(spark, sf_dir, "ocr_jobs").withColumn("due", F.col("started_at") + F.expr("interval 30 days"))
    return queue.matured(jobs, "due", _now()).select("id")


@query(f"""WITH w AS (SELECT worker_id, max(started_at) AS seen FROM ocr_jobs WHERE worker_id IS NOT NULL AND started_at IS NOT NULL AND worker_id < 'worker-20' GROUP BY 1),
    l AS (SELECT id AS job_id, worker_id FROM ocr_jobs WHERE worker_id IS NOT NULL)
    SELECT job_id, l.worker_id, CASE WHEN seen IS NULL THEN 'unknown worker' ELSE 'silent worker' END AS reason FROM l LEFT JOIN w ON l.worker_id = w.worker_id
    WHERE seen IS NULL OR floor(epoch(TIMESTAMPTZ '{_NOW}+00')) - floor(epoch(seen)) > 3600 * 24 * 7""")
def lost_leases(spark, sf_dir):
    """Jobs leased by workers that weren't seen for a week, or never (those from number 20 on)."""
    jobs = table(spark, sf_dir, "ocr_jobs").where("worker_id is not null")
    workers = jobs.where("started_at is not null and worker_id < 'worker-20'").select("worker_id", F.col("started_at").alias("last_seen"))
    leases = jobs.select(F.col("id").alias("job_id"), "worker_id", F.col("started_at").alias("leased_at"))
    return queue.lost_leases(leases, workers, _now(), 3600 * 24 * 7).select("job_id", "worker_id", "reason")


@query("""SELECT id, CASE WHEN fidelity_score IS NULL OR isnan(fidelity_score) THEN NULL ELSE greatest(0.0::DOUBLE, least(100.0::DOUBLE, fidelity_score * 150 - 20)) END AS cpu_percent,
    CASE WHEN peak_memory_mb IS NULL OR isnan(peak_memory_mb) THEN -1 ELSE greatest(0, floor(peak_memory_mb - 500)::BIGINT) END AS rss_bytes FROM ocr_metrics""")
def heartbeats(spark, sf_dir):
    """Measurements as signs of life, clamped into their bounds."""
    memory = F.when(~F.isnan("peak_memory_mb"), F.floor(F.col("peak_memory_mb") - 500).cast("bigint"))
    m = table(spark, sf_dir, "ocr_metrics").select("id", (F.col("fidelity_score") * 150 - 20).alias("cpu_percent"), memory.alias("rss_bytes"))
    return queue.signs_of_life(m).select("id", "cpu_percent", F.coalesce("rss_bytes", F.lit(-1)).alias("rss_bytes"))


@query("""SELECT id FROM (SELECT id, page_number, lag(page_number) OVER (PARTITION BY job_id ORDER BY created_at NULLS FIRST, id) AS before FROM ocr_results WHERE job_id IS NOT NULL) WHERE page_number IS DISTINCT FROM before""")
def progress_events(spark, sf_dir):
    return queue.progress(table(spark, sf_dir, "ocr_results").where("job_id is not null").select("id", "job_id", "created_at", "page_number"), "job_id", ["created_at", "id"], "page_number").select("id")


@query("""SELECT doc_id, sha256(sha256(text) || ':{"dpi": 300, "lang": "en"}:p1:m2') AS key FROM documents WHERE text IS NOT NULL""")
def fingerprints(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", queue.fingerprint(F.sha2("text", 256), {"lang": "en", "dpi": 300}, "p1", "m2").alias("key"))


_BAD = " OR ".join(f"p = '{r}' OR starts_with(p, '{r}/')" for r in queue.FORBIDDEN)


@query(f"""SELECT id, NOT ({_BAD}) AND NOT regexp_matches(p, '(^|/)\\.\\.(/|$)') AND p <> '' AS safe FROM (
    SELECT id, CASE id % 4 WHEN 0 THEN '/etc/' WHEN 1 THEN '/data/../' WHEN 2 THEN '/etcetera/' ELSE '/data/' END || filename AS p FROM ocr_jobs WHERE filename IS NOT NULL)""")
def path_safety(spark, sf_dir):
    root = F.element_at(F.array(F.lit("/etc/"), F.lit("/data/../"), F.lit("/etcetera/"), F.lit("/data/")), (F.col("id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "ocr_jobs").where("filename is not null").select("id", queue.safe_path(F.concat(root, "filename")).alias("safe"))


@query(f"SELECT count(*) FILTER (WHERE o) AS files, coalesce(sum(n) FILTER (WHERE o), 0)::BIGINT AS bytes FROM (SELECT n_chars AS n, floor(epoch(TIMESTAMPTZ '{_NOW}+00')) - floor(epoch(created_at)) > 86400 AS o FROM documents)")
def stale_sessions(spark, sf_dir):
    return queue.stale(table(spark, sf_dir, "documents"), "created_at", "n_chars", _now())


@query("""SELECT l_orderkey AS page_id, l_linenumber AS ord, l_returnflag AS text, (l_quantity * 2 - 5) / 100.0 AS confidence, (l_partkey % 900)::DOUBLE AS xmin, (l_partkey % 900 + l_suppkey % 50)::DOUBLE AS xmax
    FROM lineitem WHERE l_quantity * 2 - 5 >= 0""")
def word_detections(spark, sf_dir):
    w = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("page_id"), F.col("l_linenumber").alias("ord"), F.col("l_returnflag").alias("text"), (F.col("l_quantity") * 2 - 5).alias("conf"),
        (F.col("l_partkey") % 900).alias("left"), F.lit(10).alias("top"), (F.col("l_suppkey") % 50).alias("width"), F.lit(12).alias("height"),
    )
    d = queue.detections_of_words(w)
    return d.select("page_id", "ord", "text", "confidence", F.col("bbox.xmin").cast("double").alias("xmin"), F.col("bbox.xmax").cast("double").alias("xmax"))


@query("SELECT para_id, confidence FROM book_paragraphs WHERE is_heading AND confidence >= 0.9")
def inspected_headings(spark, sf_dir):
    b = table(spark, sf_dir, "book_paragraphs").withColumn("kind", F.when(F.col("is_heading"), "heading").otherwise("text"))
    return queue.inspected(b, "heading", 0.9).select("para_id", "confidence")


@query("""WITH a AS (SELECT job_id, page, max(CASE WHEN engine <> 'easyocr' THEN coalesce(confidence, -1) END) AS p, max(CASE WHEN engine = 'easyocr' AND trim(text) <> '' THEN coalesce(confidence, -1) END) AS s
      FROM page_results WHERE job_id IS NOT NULL AND page IS NOT NULL GROUP BY 1, 2)
    SELECT job_id, page, CASE WHEN p IS NULL OR s > p THEN 'enhanced' ELSE 'first' END AS attempt, nullif(CASE WHEN p IS NULL OR s > p THEN s ELSE p END, -1) AS confidence FROM a WHERE p IS NOT NULL OR s IS NOT NULL""")
def enhanced_pages(spark, sf_dir):
    """One engine's pages as the first pass, another's as the enhanced one."""
    p = table(spark, sf_dir, "page_results").withColumn("attempt", F.when(F.col("engine") == "easyocr", "enhanced").otherwise("first")).where("engine is not null")
    return ledger.enhanced_wins(p, "first", "enhanced")


@query(f"""WITH v AS (SELECT engine, {_OK('processing_time')} AS t FROM page_results),
    h AS (SELECT engine, b, count(*) FILTER (WHERE t <= b) AS c, lag(b, 1, 0) OVER (PARTITION BY engine ORDER BY b) AS lo FROM v, (SELECT unnest([{', '.join(f'{b}::DOUBLE' for b in ledger.BUCKETS)}]) AS b) WHERE t IS NOT NULL GROUP BY 1, 2),
    g AS (SELECT *, lag(c, 1, 0) OVER (PARTITION BY engine ORDER BY b) AS before FROM h), n AS (SELECT engine, count(*) AS n FROM v WHERE t IS NOT NULL GROUP BY 1)
    SELECT n.engine, round(coalesce((SELECT lo + (b - lo) * (0.95 * n - before) / (c - before) FROM g WHERE g.engine = n.engine AND c >= 0.95 * n AND c > before ORDER BY b LIMIT 1), {ledger.BUCKETS[-1]}) + 1e-9, 4) AS quantile FROM n""")
def bucket_quantiles(spark, sf_dir):
    """The 95th percentile as a panel reads it from cumulative buckets."""
    h = ledger.histogram(table(spark, sf_dir, "page_results"), "engine", "processing_time")
    return ledger.bucket_quantile(h, "engine", 0.95).select("engine", ledger.rounded(F.col("quantile")).alias("quantile"))
