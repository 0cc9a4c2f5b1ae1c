"""Ledger, telemetry and cache queries over jobs, pages and measurements."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliospark.operators import ledger
from foliospark.session import table

from .registry import query

_OK = lambda c: f"CASE WHEN {c} IS NOT NULL AND NOT isnan({c}) AND {c} >= 0 THEN {c} END"
_LATEST = f"""(SELECT job_id, page_number, confidence_score AS c, {_OK('processing_time')} AS t FROM ocr_results
    WHERE job_id IS NOT NULL AND page_number IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY job_id, page_number ORDER BY created_at DESC NULLS LAST, id DESC) = 1)"""


@query(f"""
    WITH p AS (SELECT job_id, count(*) AS n, avg(c) AS c, sum(t) AS t FROM {_LATEST} GROUP BY 1)
    SELECT id AS job_id, status, coalesce(page_count, n, 0)::BIGINT AS total_pages, coalesce(n, 0) AS processed_pages,
      CASE WHEN coalesce(page_count, n, 0) > 0 THEN round(least(100.0, coalesce(n, 0) * 100.0::DOUBLE / coalesce(page_count, n)), 1) ELSE 0.0 END AS progress,
      round(coalesce(c, 0.0) + 1e-9, 4) AS mean_confidence, round(coalesce(t, 0.0) + 1e-9, 2) AS total_time
    FROM ocr_jobs LEFT JOIN p ON id = job_id""")
def job_status(spark, sf_dir):
    return ledger.job_status(table(spark, sf_dir, "ocr_jobs"), table(spark, sf_dir, "ocr_results"))


@query(f"""SELECT job_id, count(*) AS pages, round(avg(t) + 1e-9, 4) AS mean_time, round(avg(c) + 1e-9, 4) AS mean_confidence,
    round(count(*) / coalesce(nullif(sum(t), 0.0), 1.0) + 1e-9, 4) AS velocity FROM {_LATEST} GROUP BY 1""")
def job_metrics(spark, sf_dir):
    return ledger.job_metrics(table(spark, sf_dir, "ocr_results"))


@query("""SELECT engine, route, error IS NOT NULL AS failed, count(*) AS pages, count(DISTINCT job_id) AS jobs FROM page_results GROUP BY ALL""")
def route_counts(spark, sf_dir):
    p = table(spark, sf_dir, "page_results")
    return p.groupBy("engine", "route", F.col("error").isNotNull().alias("failed")).agg(F.count("*").alias("pages"), F.countDistinct("job_id").alias("jobs"))


@query("""
    WITH ok AS (SELECT job_id, page, engine, coalesce(confidence, -1.0) AS c FROM page_results WHERE text IS NOT NULL AND error IS NULL AND job_id IS NOT NULL AND page IS NOT NULL),
    p AS (SELECT job_id, page, max(c) FILTER (WHERE engine = 'rapidocr') AS pc, max(c) FILTER (WHERE engine <> 'rapidocr') AS sc,
          max(CASE WHEN engine <> 'rapidocr' THEN struct_pack(c := c, e := engine) END) AS s FROM ok GROUP BY 1, 2)
    SELECT job_id, page, CASE WHEN sc IS NOT NULL AND (pc IS NULL OR sc > pc) THEN s.e ELSE 'rapidocr' END AS engine,
      CASE WHEN sc IS NOT NULL AND (pc IS NULL OR sc > pc) THEN nullif(sc, -1.0) ELSE nullif(pc, -1.0) END AS confidence FROM p""")
def ensemble_pick(spark, sf_dir):
    return ledger.best_engine(table(spark, sf_dir, "page_results"), "rapidocr")


def _stats_sql(t: str, by: str, value: str) -> str:
    v = _OK(value)
    q = ", ".join(f"round(coalesce(quantile_cont({v}, {p}), 0.0) + 1e-9, 4) AS {n}" for n, p in (("p50", 0.5), ("p75", 0.75), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99)))
    return f"""SELECT {by}, count({v}) AS n, {q}, round(coalesce(avg({v}), 0.0) + 1e-9, 4) AS mean, round(coalesce(min({v}), 0.0) + 1e-9, 4) AS least,
        round(coalesce(max({v}), 0.0) + 1e-9, 4) AS most, round(coalesce(stddev_pop({v}), 0.0) + 1e-9, 4) AS std FROM {t} GROUP BY 1"""


@query(_stats_sql("page_results", "engine", "processing_time"))
def latency_stats(spark, sf_dir):
    return ledger.latency_stats(table(spark, sf_dir, "page_results"), "engine", "processing_time")


@query(f"""SELECT engine, p95 <= 10.0 AND pages_per_second >= 0.2 AS passed, p95, pages_per_second FROM (
    SELECT engine, round(coalesce(quantile_cont(t, 0.95), 0.0), 4) AS p95, round(CASE WHEN coalesce(sum(t), 0) > 0 THEN count(*) / sum(t) ELSE 0.0 END, 4) AS pages_per_second
    FROM (SELECT engine, {_OK('processing_time')} AS t FROM page_results) GROUP BY 1)""")
def sla_gate(spark, sf_dir):
    pages, t = table(spark, sf_dir, "page_results"), ledger.measured(F.col("processing_time"))
    speed = pages.groupBy("engine").agg(F.round(F.when(F.coalesce(F.sum(t), F.lit(0.0)) > 0, F.count("*") / F.sum(t)).otherwise(F.lit(0.0)), 4).alias("pages_per_second"))
    p = ledger.percentiles(pages, ["engine"], t, (0.95,)).select(F.col("engine").alias("e"), F.col("p")[0].alias("p"))
    g = speed.join(p, F.col("engine").eqNullSafe(F.col("e")), "left").withColumn("p95", F.round(F.coalesce("p", F.lit(0.0)), 4))
    return g.select("engine", ((F.col("p95") <= 10.0) & (F.col("pages_per_second") >= 0.2)).alias("passed"), "p95", "pages_per_second")


@query("""
    WITH r AS (SELECT job_id, peak_memory_mb AS y, row_number() OVER (PARTITION BY job_id ORDER BY timestamp NULLS FIRST, id)::DOUBLE AS x FROM ocr_metrics WHERE peak_memory_mb IS NOT NULL),
    f AS (SELECT job_id, count(*) AS n, regr_slope(y, x) AS s, regr_intercept(y, x) AS i, regr_r2(y, x) AS r, var_pop(y) AS v FROM r WHERE x > 1 GROUP BY 1)
    SELECT job_id, n, round(CASE WHEN n < 2 THEN 0.0 ELSE s END, 6) AS slope, round(CASE WHEN n < 2 THEN 0.0 ELSE i END, 6) AS intercept,
      round(CASE WHEN n < 2 OR v <= 1e-12 THEN 0.0 ELSE r END, 6) AS r2, (n < 2 OR s <= 0.05) AS passed FROM f""")
def leak_slope(spark, sf_dir):
    return ledger.slopes(table(spark, sf_dir, "ocr_metrics"), "job_id", ["timestamp", "id"], "peak_memory_mb", warm_up=1, bucket=F.to_date("timestamp"))


@query("""SELECT job_id, count(*) AS samples, arg_min(peak_memory_mb, (timestamp, id)) AS first, max(peak_memory_mb) AS peak, round(avg(peak_memory_mb) + 1e-9, 4) AS mean,
    round(arg_max(peak_memory_mb, (timestamp, id)) - arg_min(peak_memory_mb, (timestamp, id)), 4) AS delta FROM ocr_metrics WHERE peak_memory_mb IS NOT NULL GROUP BY 1""")
def resource_summary(spark, sf_dir):
    return ledger.resource_summary(table(spark, sf_dir, "ocr_metrics"), "job_id", "timestamp", "peak_memory_mb")


@query(f"""SELECT engine, le, count(*) FILTER (WHERE le = '+Inf' OR t <= TRY_CAST(le AS DOUBLE)) AS count FROM
    (SELECT engine, {_OK('processing_time')} AS t FROM page_results), (SELECT unnest([{', '.join(f"'{b}'" for b in ledger.BUCKETS)}, '+Inf']) AS le) WHERE t IS NOT NULL GROUP BY 1, 2""")
def latency_histogram(spark, sf_dir):
    return ledger.histogram(table(spark, sf_dir, "page_results"), "engine", "processing_time")


@query("""SELECT tier, count(id) AS jobs FROM (SELECT unnest(['high', 'default', 'low', 'dlq']) AS tier) LEFT JOIN
    (SELECT id, CASE WHEN dlq_at IS NOT NULL THEN 'dlq' ELSE priority END AS p FROM ocr_jobs) ON tier = p GROUP BY 1""")
def queue_depths(spark, sf_dir):
    tiers = spark.createDataFrame([("high",), ("default",), ("low",), ("dlq",)], "tier string")
    jobs = table(spark, sf_dir, "ocr_jobs").select(F.when(F.col("dlq_at").isNotNull(), "dlq").otherwise(F.col("priority")).alias("tier")).groupBy("tier").agg(F.count("*").alias("n"))
    return tiers.join(jobs, "tier", "left").select("tier", F.coalesce("n", F.lit(0)).alias("jobs"))


@query("SELECT id, filename, status FROM ocr_jobs ORDER BY created_at DESC NULLS LAST, id DESC LIMIT 50")
def recent_jobs(spark, sf_dir):
    """The newest fifty jobs: a top-k report."""
    return table(spark, sf_dir, "ocr_jobs").orderBy(F.desc_nulls_last("created_at"), F.desc("id")).limit(50).select("id", "filename", "status")


@query("""SELECT job_id, arg_max(id, (timestamp, id)) AS id, arg_max(fidelity_score, (timestamp, id)) AS fidelity_score FROM ocr_metrics WHERE timestamp IS NOT NULL AND fidelity_score IS NOT NULL GROUP BY 1""")
def latest_metric(spark, sf_dir):
    m = table(spark, sf_dir, "ocr_metrics").where("timestamp is not null and fidelity_score is not null")
    return m.groupBy("job_id").agg(F.max(F.struct("timestamp", "id", "fidelity_score")).alias("r")).select("job_id", "r.id", "r.fidelity_score")


_CUTOFF = "2025-06-01 00:00:00"


@query(f"SELECT r.id, r.job_id FROM ocr_results r WHERE NOT EXISTS (SELECT 1 FROM ocr_jobs j WHERE j.id = r.job_id AND j.completed_at < TIMESTAMPTZ '{_CUTOFF}+00')")
def retention(spark, sf_dir):
    r = table(spark, sf_dir, "ocr_results").select("id", "job_id")
    return ledger.retained(r, table(spark, sf_dir, "ocr_jobs"), F.lit(_CUTOFF).cast("timestamp")).select("id", "job_id")


@query("""SELECT seen, file, status, origin FROM (
    SELECT *, row_number() OVER (PARTITION BY seen, file, status ORDER BY o, origin) AS k FROM (
      SELECT floor(epoch(created_at))::BIGINT AS seen, filename AS file, status, 'queue' AS origin, 0 AS o FROM ocr_jobs WHERE queue_name IS NOT NULL
      UNION ALL SELECT floor(epoch(created_at))::BIGINT, filename, status, 'ledger', 1 FROM ocr_jobs)) WHERE k = 1""")
def audit_union(spark, sf_dir):
    j = table(spark, sf_dir, "ocr_jobs").select(F.unix_timestamp("created_at").alias("seen"), F.col("filename").alias("file"), "status", "queue_name")
    a = j.where("queue_name is not null").select("seen", "file", "status", F.lit("queue").alias("origin"))
    b = j.select("seen", "file", "status", F.lit("ledger").alias("origin"))
    return ledger.first_wins(a, b, ["seen", "file", "status"])


@query("SELECT id, needle FROM ocr_jobs, (SELECT unnest(['.PDF', 'Fail', '2025-03-0']) AS needle) WHERE coalesce(contains(lower(filename), lower(needle)), false) OR coalesce(contains(lower(status), lower(needle)), false) OR coalesce(contains(strftime(created_at AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S'), lower(needle)), false)")
def audit_search(spark, sf_dir):
    """Three searches: by file name, by status, by time."""
    jobs, out = table(spark, sf_dir, "ocr_jobs"), None
    for needle in (".PDF", "Fail", "2025-03-0"):
        found = ledger.search(jobs, needle).select("id", F.lit(needle).alias("needle"))
        out = found if out is None else out.unionByName(found)
    return out


@query("SELECT doc_id, sha256(text) AS digest, sha256(sha256(text) || ':text:v2') AS key FROM documents WHERE text IS NOT NULL")
def content_hashes(spark, sf_dir):
    from foliospark.operators.cache import content_hash, namespaced

    d = table(spark, sf_dir, "documents").where("text is not null").withColumn("digest", content_hash(F.encode("text", "UTF-8")))
    return d.select("doc_id", "digest", namespaced(F.col("digest"), "text", "v2").alias("key"))


@query("SELECT epoch(time_bucket(INTERVAL '1 hour', created_at))::BIGINT AS start, count(*) AS rows FROM ocr_results WHERE created_at IS NOT NULL GROUP BY 1")
def rate_panel(spark, sf_dir):
    return ledger.rate_panel(table(spark, sf_dir, "ocr_results"), "created_at", "1 hour").select(F.unix_timestamp("start").alias("start"), "rows")


@query(f"""SELECT epoch(time_bucket(INTERVAL '1 day', created_at, TIMESTAMPTZ '2000-01-01 00:00:00+00'))::BIGINT AS start, round(quantile_cont(t, 0.5) + 1e-9, 4) AS p50, round(quantile_cont(t, 0.95) + 1e-9, 4) AS p95
    FROM (SELECT created_at, {_OK('processing_time')} AS t FROM ocr_results WHERE created_at IS NOT NULL) WHERE t IS NOT NULL GROUP BY 1""")
def quantile_panel(spark, sf_dir):
    return ledger.quantile_panel(table(spark, sf_dir, "ocr_results"), "created_at", "1 day", "processing_time").select(F.unix_timestamp("start").alias("start"), "p50", "p95")


@query("""SELECT event_type, count(*) AS n, round(avg(value) + 1e-9, 4) AS mean, floor(epoch(max(ts)))::BIGINT AS last FROM events GROUP BY 1""")
def event_counts(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), ledger.rounded(F.avg("value")).alias("mean"), F.unix_timestamp(F.max("ts").cast("timestamp")).alias("last"))


@query("""SELECT worker_id, floor(epoch(last_seen))::BIGINT AS last_seen, last_seen >= (SELECT max(started_at) FROM ocr_jobs) - INTERVAL '7 days' AS alive FROM
    (SELECT worker_id, max(started_at) AS last_seen FROM ocr_jobs WHERE worker_id IS NOT NULL AND started_at IS NOT NULL GROUP BY 1)""")
def worker_liveness(spark, sf_dir):
    seen = table(spark, sf_dir, "ocr_jobs").where("worker_id is not null and started_at is not null").groupBy("worker_id").agg(F.max("started_at").alias("last_seen"))
    newest = F.max("last_seen").over(Window.partitionBy())  # one row per worker
    return seen.withColumn("newest", newest).select("worker_id", F.unix_timestamp("last_seen").alias("last_seen"), (F.col("last_seen") >= F.col("newest") - F.expr("interval 7 days")).alias("alive"))


@query("""SELECT doc_id FROM (SELECT doc_id, n_chars, sum(n_chars) OVER (ORDER BY created_at, doc_id) AS run, sum(n_chars) OVER () AS total FROM documents WHERE created_at IS NOT NULL AND n_chars IS NOT NULL)
    WHERE total - (run - n_chars) > 500000""")
def cache_prune(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("created_at is not null and n_chars is not null").select("doc_id", "created_at", "n_chars")
    return ledger.pruned(d, F.lit(500000), F.to_date("created_at"), ["created_at", "doc_id"], "n_chars").select("doc_id")


@query("""SELECT id, job_id, ((row_number() OVER (PARTITION BY job_id ORDER BY length(extracted_text), id) - 1) // 8)::BIGINT AS batch FROM ocr_results WHERE extracted_text IS NOT NULL AND job_id IS NOT NULL""")
def batch_buckets(spark, sf_dir):
    r = table(spark, sf_dir, "ocr_results").where("extracted_text is not null and job_id is not null").select("id", "job_id", F.length("extracted_text").alias("n"))
    return ledger.batches(r, "job_id", ["n", "id"], 8).select("id", "job_id", "batch")


@query("""WITH h AS (SELECT id, sha256(sha256(extracted_text) || ':rapidocr:v1') AS key FROM ocr_results WHERE extracted_text IS NOT NULL),
    c AS (SELECT sha256(sha256(text) || ':rapidocr:v1') AS key FROM page_results WHERE text IS NOT NULL)
    SELECT id, key IN (SELECT key FROM c) AS hit FROM h""")
def cache_lookup(spark, sf_dir):
    """Pages whose text was cached under the same namespace: hits and what is still to do."""
    from foliospark.operators.cache import cache_key

    h = table(spark, sf_dir, "ocr_results").where("extracted_text is not null").select("id", cache_key(F.sha2("extracted_text", 256), "rapidocr", "v1").alias("key"))
    c = table(spark, sf_dir, "page_results").where("text is not null").select(cache_key(F.sha2("text", 256), "rapidocr", "v1").alias("key")).distinct().withColumn("hit", F.lit(True))
    return h.join(c, "key", "left").select("id", F.coalesce("hit", F.lit(False)).alias("hit"))
