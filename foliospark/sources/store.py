"""Objects of jobs in any file system that the cluster reads: one key, one file.

Many objects go through :func:`put_all` and :func:`get_all`, whose tasks write and read in
parallel, each file under another name first; a failed task is tried again by the cluster.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SAFE = re.compile(r"[A-Za-z0-9._-]+(?:/[A-Za-z0-9._-]+)*")


def job_key(job: int | str, name: str) -> str:
    return f"jobs/{job}/{name}"


class Store:
    """Objects below a root path (local, HDFS or an object store that Hadoop knows)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, key: str) -> str:
        """The object's path. Keys with steps upwards, blanks or an absolute path are refused."""
        if not _SAFE.fullmatch(key) or ".." in key.split("/") or "." in key.split("/"):
            raise ValueError(f"no key of this store: {key!r}")
        return f"{self.root}/{key}"

    def put(self, key: str, data: bytes) -> None:
        """Written under another name and then renamed, so that no reader sees a part of it."""
        final, part = self._path(self.path(key)), self._path(f"{self.path(key)}.{uuid.uuid4().hex}.part")
        self._fs.mkdirs(final.getParent())
        out = self._fs.create(part, True)
        try:
            out.write(data)
        finally:
            out.close()
        self._fs.delete(final, False)
        if not self._fs.rename(part, final):
            raise OSError(f"{key} can't be written")

    def get(self, key: str) -> bytes:
        if not self.exists(key):
            raise KeyError(key)
        row = self.spark.read.format("binaryFile").load(self.path(key)).select("content").first()
        return bytes(row.content) if row else b""

    def exists(self, key: str) -> bool:
        return self._fs.exists(self._path(self.path(key)))

    def delete(self, key: str) -> bool:
        return self._fs.delete(self._path(self.path(key)), False)

    def put_all(self, objects: DataFrame) -> DataFrame:
        """``key, bytes`` of the stored ``key, data``: rows are spread over the tasks by key. Executors
        must reach the root as a mounted path; other file systems take :meth:`put`."""
        import os

        from foliospark.arrow import map_batches

        root = self.root.removeprefix("file://")

        def make():
            def run(keys, datas):
                rows = []
                for k, d in zip(keys, datas):
                    if not _SAFE.fullmatch(k or "") or {".", ".."} & set(k.split("/")):
                        rows.append((k, None, "no key of this store"))
                        continue
                    final = f"{root}/{k}"
                    os.makedirs(os.path.dirname(final), exist_ok=True)
                    part = f"{final}.{uuid.uuid4().hex}.part"
                    with open(part, "wb") as f:
                        f.write(d or b"")
                    os.replace(part, final)
                    rows.append((k, len(d or b""), None))
                return rows

            return run

        return map_batches(objects.select("key", "data").repartition("key"), make, "key string, bytes bigint, error string")

    def get_all(self, prefix: str = "") -> DataFrame:
        """``key, data, bytes`` of all objects below a prefix; the listing leaves empty ones out."""
        base = self.path(prefix) if prefix else self.root
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
        cut_ = F.length(F.lit(self.root.split("://")[-1])) + 1
        path = F.regexp_replace("path", "^[a-z0-9]+:(//[^/]*)?(?=/)", "")
        return files.where(~F.col("path").endswith(".part")).select(F.substr(path, cut_ + F.lit(1), F.length(path)).alias("key"), F.col("content").alias("data"), F.col("length").alias("bytes"))
