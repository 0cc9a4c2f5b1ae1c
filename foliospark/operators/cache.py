"""Content hashes and cache keys as columns; lookups are joins on the key. A cache is a table
of entries in a shared folder, written in generations, over which a tier in memory may lie."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Contents up to this size are hashed whole, larger ones by their ends and size (fixed values).
WHOLE, END = 10 * 1024 * 1024, 64 * 1024


def content_hash(content: Column) -> Column:
    n = F.length(content)
    ends = F.concat(F.substring(content, 1, END), n.cast("string").cast("binary"), F.substring(content, -END, END))
    return F.sha2(F.when(n <= WHOLE, content).otherwise(ends), 256)


def cache_key(hash_: Column, *namespace: str) -> Column:
    return F.sha2(F.concat_ws(":", hash_, *map(F.lit, namespace)), 256)


def to_do(wanted: DataFrame, cached: DataFrame, key: str = "key") -> DataFrame:
    """What the cache lacks."""
    return wanted.join(cached.select(key).distinct(), key, "left_anti")


NAMESPACES = ("native", "layout", "text", "table", "export")


def namespaced(hash_: Column, namespace: str, *parts: str) -> Column:
    """Key in a known namespace; another one is an error."""
    if namespace not in NAMESPACES:
        raise ValueError(f"no namespace {namespace!r}; known: {NAMESPACES}")
    return cache_key(hash_, namespace, *parts)


class Cache:
    """Entries ``key, value, at`` under a folder. What is put goes into a new generation, written
    as a whole before it is seen; the newest generation of a key wins, and a null value is a
    key taken back. :meth:`hot` keeps entries in the executors' memory in front of the files."""

    SCHEMA = "key string, value string, at timestamp, generation bigint"

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hot: DataFrame | None = None

    def _generations(self) -> list[int]:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(p):
            return []
        names = [x.getPath().getName() for x in fs.listStatus(p) if x.isDirectory()]
        return sorted(int(n[2:]) for n in names if n[:2] == "g-" and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS")))

    def put(self, entries: DataFrame) -> None:
        """``key, value`` of new or changed entries; of a key that is there twice the greatest value."""
        n = (self._generations() or [0])[-1] + 1
        once = entries.where("key is not null").groupBy("key").agg(F.max("value").alias("value"))
        once.select("key", "value", F.current_timestamp().alias("at"), F.lit(n).cast("bigint").alias("generation")).write.parquet(f"{self.path}/g-{n}")

    def invalidate(self, keys: DataFrame) -> None:
        self.put(keys.select("key", F.lit(None).cast("string").alias("value")))

    def entries(self) -> DataFrame:
        """``key, value, at`` of what is valid now."""
        done = self._generations()
        if not done:
            return self.spark.createDataFrame([], self.SCHEMA).drop("generation")
        rows = self.spark.read.schema(self.SCHEMA).parquet(*[f"{self.path}/g-{n}" for n in done])
        last = rows.groupBy("key").agg(F.max(F.struct("generation", "value", "at")).alias("r"))
        return last.select("key", "r.value", "r.at").where("value is not null")

    def get(self, wanted: DataFrame) -> DataFrame:
        """``key, value`` of the wanted keys that are there: from memory first, then from the files."""
        keys = wanted.select("key").distinct()
        if self._hot is None:
            return keys.join(self.entries().select("key", "value"), "key")
        near = keys.join(self._hot, "key")
        return near.unionByName(keys.join(self._hot, "key", "left_anti").join(self.entries().select("key", "value"), "key"))

    def hot(self, limit: int) -> None:
        """Keep the ``limit`` entries that were written last in memory, and let go of others."""
        if self._hot is not None:
            self._hot.unpersist()
        self._hot = self.entries().orderBy(F.desc("at"), "key").limit(limit).select("key", "value").persist()

    def compact(self) -> None:
        """One generation of what is valid; older ones go once it is whole."""
        old = self._generations()
        if not old:
            return
        self.entries().select("key", "value", "at", F.lit(old[-1] + 1).cast("bigint").alias("generation")).write.parquet(f"{self.path}/g-{old[-1] + 1}")
        for n in old:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/g-{n}")
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
