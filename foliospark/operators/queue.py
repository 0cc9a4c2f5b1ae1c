"""Data side of a job queue: order of work, matured delays, lost leases, signs of life, progress,
and what may be read and kept. The rules of its states are not part of this engine."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ledger import row_numbers

#: Tiers of work, most urgent first, and folders that no job may read (fixed values).
TIERS = ("high", "default", "low")
FORBIDDEN = ("/etc", "/root", "/proc", "/sys", "/dev", "/boot", "/var/run")


def dequeue_order(jobs: DataFrame, tier: str, at: str, key: str) -> DataFrame:
    """``place`` from 1 in which waiting jobs are taken: strictly by tier, then first come first
    served. Unknown and null tiers count as ``default``. Places are counted by tier and day, so
    that the queue never meets in one task."""
    rank = F.lit(TIERS.index("default"))
    for k, t in enumerate(TIERS):
        rank = F.when(F.lower(tier) == t, F.lit(k)).otherwise(rank)
    day = F.date_format(F.coalesce(F.col(at), F.lit("1970-01-01").cast("timestamp")), "yyyyMMdd")
    ranked = jobs.withColumn("_rank", rank).withColumn("_at", F.coalesce(F.col(at), F.lit("1970-01-01").cast("timestamp")))
    return row_numbers(ranked, [], F.concat(F.col("_rank").cast("string"), day), ["_rank", "_at", key], "place").drop("_rank", "_at")


def matured(jobs: DataFrame, due: str, now: Column) -> DataFrame:
    """Delayed jobs whose time has come."""
    return jobs.where(F.col(due).isNotNull() & (F.col(due) <= now))


def lost_leases(leases: DataFrame, workers: DataFrame, now: Column, timeout_s: int) -> DataFrame:
    """Leases (``job_id, worker_id, leased_at``) whose worker (``worker_id, last_seen``) is unknown
    or wasn't seen for ``timeout_s``, with the reason."""
    seen = workers.where("worker_id is not null").groupBy("worker_id").agg(F.max("last_seen").alias("last_seen"))
    j = leases.join(seen, "worker_id", "left")
    silent = F.unix_timestamp(now) - F.unix_timestamp("last_seen")
    reason = F.when(F.col("last_seen").isNull(), "unknown worker").when(silent > timeout_s, "silent worker")
    return j.withColumn("reason", reason).where("reason is not null").select("job_id", "worker_id", "leased_at", "reason")


def signs_of_life(beats: DataFrame) -> DataFrame:
    """Heartbeats with their figures in bounds: ``cpu_percent`` 0 to 100, ``rss_bytes`` from 0."""
    clamp = lambda c, lo, hi=None: F.greatest(F.lit(lo), c if hi is None else F.least(F.lit(hi), c))
    cpu = F.when(F.col("cpu_percent").isNotNull() & ~F.isnan("cpu_percent"), clamp(F.col("cpu_percent"), 0.0, 100.0))
    return beats.withColumn("cpu_percent", cpu).withColumn("rss_bytes", F.when(F.col("rss_bytes").isNotNull(), clamp(F.col("rss_bytes"), 0)))


def progress(events: DataFrame, job: str, order: list[str], count: str) -> DataFrame:
    """The events of a job at which its count differs from the one before: what a reader of its
    progress is sent."""
    before = F.lag(count).over(Window.partitionBy(job).orderBy(*order))
    return events.withColumn("_before", before).where(~F.col(count).eqNullSafe(F.col("_before"))).drop("_before")


def fingerprint(content_sha: Column, config: dict, pipeline: str, model: str) -> Column:
    """Key of a result: content, settings in sorted order, versions."""
    return F.sha2(F.concat_ws(":", content_sha, F.lit(json.dumps(config, sort_keys=True)), F.lit(pipeline), F.lit(model)), 256)


def safe_path(path: Column, forbidden: tuple[str, ...] = FORBIDDEN) -> Column:
    """Whether a path lies outside the forbidden folders, has no step upwards and no null sign."""
    inside = F.lit(False)
    for root in forbidden:
        inside = inside | (path == root) | path.startswith(root + "/")
    return F.coalesce(~inside & ~path.rlike(r"(^|/)\.\.(/|$)") & ~path.contains("\u0000") & (path != ""), F.lit(False))


def stale(files: DataFrame, at: str, size: str, now: Column, hours: int = 24) -> DataFrame:
    """One row: files older than ``hours`` and the bytes that they hold."""
    old = F.unix_timestamp(now) - F.unix_timestamp(at) > hours * 3600
    return files.agg(F.count_if(old).alias("files"), F.coalesce(F.sum(F.when(old, F.col(size))), F.lit(0)).alias("bytes"))


def detections_of_words(words: DataFrame) -> DataFrame:
    """Words of an engine that gives left, top, width, height and a confidence of 0 to 100 (below
    0 for no word) as detections: blank ones go."""
    ok = words.where((F.col("conf") >= 0) & (F.trim("text") != ""))
    box = F.struct(F.col("left").alias("xmin"), F.col("top").alias("ymin"), (F.col("left") + F.col("width")).alias("xmax"), (F.col("top") + F.col("height")).alias("ymax"))
    return ok.select("page_id", "ord", "text", (F.col("conf") / 100.0).alias("confidence"), box.alias("bbox"))


def inspected(blocks: DataFrame, kind: str = "ALL", least: float = 0.0, most_rows: int | None = None) -> DataFrame:
    """Blocks of one kind (or all) with at least that confidence; ``most_rows`` is what a screen
    shows of them."""
    out = blocks.where(F.col("confidence") >= least)
    out = out if kind == "ALL" else out.where(F.col("kind") == kind)
    return out if most_rows is None else out.orderBy(*[c for c in ("page_id", "ord") if c in out.columns]).limit(most_rows)
