"""Streams run over what a table holds now, and must equal the batch result."""

from __future__ import annotations

from foliospark.streaming import streams

from .registry import query


@query("SELECT epoch(time_bucket(INTERVAL '1 day', ts, TIMESTAMP '2000-01-01 00:00:00'))::BIGINT AS start, event_type, count(*) AS rows FROM events GROUP BY 1, 2")
def stream_rates(spark, sf_dir):
    return streams.run_once(streams.rates(streams.file_stream(spark, f"{sf_dir}/events.parquet"), "ts", "1 day", "60 days", "event_type"), "complete").selectExpr("unix_timestamp(start) AS start", "event_type", "rows")


@query("SELECT user_id, event_type, count(*) > 0 AS seen FROM events GROUP BY 1, 2")
def stream_dedup(spark, sf_dir):
    """One row for each user and kind of event, as all lie within the time to live."""
    s = streams.first_within(streams.file_stream(spark, f"{sf_dir}/events.parquet"), "ts", "3650 days", "user_id", "event_type")
    return streams.run_once(s).selectExpr("user_id", "event_type", "true AS seen")
