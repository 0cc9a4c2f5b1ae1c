"""Structured Streaming: rates, repeated jobs, live workers and page sinks over file streams.

In ``append`` mode state is bounded by watermarks: windows close, keys expire. ``complete``
keeps every window it has counted, so it suits small results such as daily rates. The
checkpoint of each query belongs in the shared folder that the session names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.session import scratch


def file_stream(spark: SparkSession, path: str, files_per_trigger: int = 8) -> DataFrame:
    """Parquet files of a folder (or one file) as a stream with the schema that they have."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    return reader.option("pathGlobFilter", name).parquet(folder) if _is_file(spark, path) else reader.parquet(path)


def _is_file(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isFile()


def _timed(stream: DataFrame, at: str) -> DataFrame:
    """Event time with the session's zone, as watermarks want it."""
    return stream.withColumn(at, F.col(at).cast("timestamp"))


def rates(stream: DataFrame, at: str, width: str, late: str, *by: str) -> DataFrame:
    """Rows a window; rows later than ``late`` behind the newest are no longer counted."""
    w = _timed(stream, at).where(F.col(at).isNotNull()).withWatermark(at, late).groupBy(F.window(at, width).alias("w"), *by).agg(F.count("*").alias("rows"))
    return w.select(F.col("w.start").alias("start"), *by, "rows")


def first_within(stream: DataFrame, at: str, ttl: str, *key: str) -> DataFrame:
    """The first row of each key; others within ``ttl`` of the watermark are repetitions. (A
    lock's time to live counts from its holder by the clock, this by event time.)"""
    return _timed(stream, at).withWatermark(at, ttl).dropDuplicatesWithinWatermark(list(key))


def live_workers(stream: DataFrame, at: str, ttl: str, worker: str) -> DataFrame:
    """Sessions of workers: from the first to the last sign of life without a gap of ``ttl``."""
    s = _timed(stream, at).where(F.col(worker).isNotNull()).withWatermark(at, ttl).groupBy(F.session_window(at, ttl).alias("s"), worker).agg(F.count("*").alias("beats"), F.max(at).alias("last_seen"))
    return s.select(worker, F.col("s.start").alias("since"), "last_seen", "beats")


def run_once(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Everything there is now through the stream into a folder of the shared directory, read
    back as a table. ``complete`` and ``update`` go through a batch sink that overwrites."""
    spark = stream.sparkSession
    base = scratch(spark, "stream")
    writer = stream.writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    if mode == "append":
        q = writer.outputMode("append").format("parquet").option("path", f"{base}/rows").start()
    else:
        q = writer.outputMode(mode).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{base}/rows")).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")


def page_writer(stream: DataFrame, path: str, checkpoint: str):
    """Pages appended batch by batch; the last write of a page wins when read with
    :func:`last_pages`."""

    def write(df: DataFrame, batch: int) -> None:
        df.withColumn("batch", F.lit(batch)).write.mode("append").parquet(path)

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def last_pages(spark: SparkSession, path: str, *key: str) -> DataFrame:
    pages = spark.read.parquet(path)
    rest = [c for c in pages.columns if c not in (*key, "batch")]
    return pages.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col("batch")).alias("r")).select(*key, "r.*")
