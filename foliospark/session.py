"""Session helpers: configuration for local work, the shared folder, and lineage cuts."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings that every session of this library wants; a cluster may override the sizes.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: str = "8", **extra: str) -> SparkSession:
    """A session for tests and the bench: one JVM, UTC, few shuffle partitions."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("foliospark")
    conf = DEFAULTS | {
        "spark.sql.shuffle.partitions": cores,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    }
    for k, v in (conf | extra).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``. Only on one machine (a ``local``
    master), where that is unset, a folder under the temporary directory is set instead; on a
    cluster an unset folder is an error, since executors don't share a machine's own."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
        named = os.path.join(tempfile.gettempdir(), "foliospark-checkpoints")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
        _drop_at_end(spark, sc.getCheckpointDir())  # the session's own folder below the named one
    return named


def _drop_at_end(spark: SparkSession, path: str) -> None:
    """Remove a folder when the driver's JVM ends."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(p)
    fs.deleteOnExit(p)


def scratch(spark: SparkSession, kind: str) -> str:
    """A new folder of this session in the shared one; it goes when the session's JVM ends."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/foliospark-{kind}-{uuid.uuid4().hex}"
    _drop_at_end(spark, path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the copy. The copy outlives
    the executors that made it, so a lost executor costs no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def keep(df: DataFrame) -> DataFrame:
    """As :func:`cut`, as a table: of what is read several times, each reader takes its columns."""
    path = scratch(df.sparkSession, "table") + "/rows"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
