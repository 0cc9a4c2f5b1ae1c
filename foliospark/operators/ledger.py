"""The job ledger: pages, jobs and measurements, their joins, aggregates and windows.

Saved pages may repeat; :func:`latest_pages` keeps one row for each page of a job. Groups by
job or page aggregate partially before the exchange, so a job with a third of all pages
costs its partial rows only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def rounded(c: Column, digits: int = 4) -> Column:
    """Rounded so that a tie doesn't hang on the last bit of a sum."""
    return F.round(c + F.lit(1e-9), digits)


def measured(c: Column) -> Column:
    """A time where it is a measurement; the timer leaves null, NaN or -1 where it failed."""
    return F.when(c.isNotNull() & ~F.isnan(c) & (c >= 0), c)


def latest_pages(results: DataFrame) -> DataFrame:
    """The last save of each page: an aggregate, so no window has to sort a whole job."""
    row = F.struct("created_at", "id", "extracted_text", "confidence_score", "processing_time")
    last = results.where("job_id is not null and page_number is not null").groupBy("job_id", "page_number").agg(F.max(row).alias("r"))
    return last.select("job_id", "page_number", "r.id", "r.extracted_text", "r.confidence_score", "r.processing_time", "r.created_at")


def latest_keys(results: DataFrame) -> DataFrame:
    """As :func:`latest_pages` without the text, which then isn't even read."""
    row = F.struct("created_at", "id", "confidence_score", "processing_time")
    last = results.where("job_id is not null and page_number is not null").groupBy("job_id", "page_number").agg(F.max(row).alias("r"))
    return last.select("job_id", "page_number", "r.id", "r.confidence_score", "r.processing_time", "r.created_at")


def job_status(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """Every job with the pages found for it, progress, mean confidence and total time."""
    per = latest_keys(results).groupBy("job_id").agg(
        F.count("*").alias("processed"), F.avg("confidence_score").alias("conf"), F.sum(measured(F.col("processing_time"))).alias("time")
    )
    both = jobs.select("id", "status", "page_count").join(per, F.col("id") == F.col("job_id"), "left")
    done = F.coalesce("processed", F.lit(0))
    total = F.coalesce("page_count", done)
    return both.select(
        F.col("id").alias("job_id"),
        "status",
        total.cast("bigint").alias("total_pages"),
        done.alias("processed_pages"),
        F.when(total > 0, F.round(F.least(F.lit(100.0), done * 100.0 / total), 1)).otherwise(F.lit(0.0)).alias("progress"),
        rounded(F.coalesce("conf", F.lit(0.0))).alias("mean_confidence"),
        rounded(F.coalesce("time", F.lit(0.0)), 2).alias("total_time"),
    )


def job_metrics(results: DataFrame) -> DataFrame:
    """Per job: pages, mean time and confidence, and pages a second (of one second at least
    where no time was measured)."""
    t = measured(F.col("processing_time"))
    return latest_keys(results).groupBy("job_id").agg(
        F.count("*").alias("pages"),
        rounded(F.avg(t)).alias("mean_time"),
        rounded(F.avg("confidence_score")).alias("mean_confidence"),
        rounded(F.count("*") / F.coalesce(F.nullif(F.sum(t), F.lit(0.0)), F.lit(1.0))).alias("velocity"),
    )


def enhanced_wins(pages: DataFrame, first: str, second: str) -> DataFrame:
    """Per page the row of pass ``first``, unless pass ``second`` (column ``attempt``) read text
    and is strictly more confident: ``job_id, page, attempt, confidence``."""
    row = F.struct(F.coalesce("confidence", F.lit(-1.0)).alias("c"), F.col("attempt").alias("a"))
    per = pages.where("job_id is not null and page is not null").groupBy("job_id", "page").agg(
        F.max(F.when(F.col("attempt") == first, row)).alias("p"), F.max(F.when((F.col("attempt") == second) & (F.trim("text") != ""), row)).alias("s")
    )
    pick = F.when(F.col("p").isNull() | F.coalesce(F.col("s.c") > F.col("p.c"), F.lit(False)), F.col("s")).otherwise(F.col("p"))
    return per.select("job_id", "page", pick.alias("r")).where("r is not null").select("job_id", "page", F.col("r.a").alias("attempt"), F.when(F.col("r.c") >= 0, F.col("r.c")).alias("confidence"))


def bucket_quantile(histogram_: DataFrame, by: str, q: float) -> DataFrame:
    """A quantile from cumulative buckets ``le, count``, linear within the bucket that holds it;
    the last finite bound where it lies beyond, null without rows."""
    bound = F.when(F.col("le") == "+Inf", F.lit(float("inf"))).otherwise(F.expr("try_cast(le as double)"))
    per = histogram_.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(bound.alias("b"), F.col("count").cast("double").alias("c")))).alias("x"))
    total = F.element_at("x", -1)["c"]
    start = F.struct(F.lit(0.0).alias("b"), F.lit(0.0).alias("c"), F.lit(None).cast("double").alias("v"))
    rank = F.lit(q) * total
    inner = lambda z, x: z["b"] + (x["b"] - z["b"]) * (rank - z["c"]) / (x["c"] - z["c"])
    value = lambda z, x: F.when(x["b"] == float("inf"), z["b"]).otherwise(inner(z, x))
    step = lambda z, x: F.struct(
        F.when(x["b"] == float("inf"), z["b"]).otherwise(x["b"]).alias("b"), x["c"].alias("c"),
        F.when(z["v"].isNull() & (x["c"] >= rank) & (x["c"] > z["c"]), value(z, x)).otherwise(z["v"]).alias("v"),
    )
    return per.select(by, F.when(total > 0, F.aggregate("x", start, step)["v"]).alias("quantile"))


def best_engine(pages: DataFrame, primary: str) -> DataFrame:
    """Per page the primary engine's row, unless another engine is strictly more confident."""
    ok = pages.where("text is not null and error is null and job_id is not null and page is not null")
    row = F.struct(F.coalesce("confidence", F.lit(-1.0)).alias("c"), F.col("engine").alias("e"), F.xxhash64("text").alias("h"))
    per = ok.groupBy("job_id", "page").agg(F.max(F.when(F.col("engine") == primary, row)).alias("p"), F.max(F.when(F.col("engine") != primary, row)).alias("s"))
    second = F.col("p").isNull() | (F.col("s.c") > F.col("p.c"))
    pick = F.when(F.coalesce(second, F.lit(False)) & F.col("s").isNotNull(), F.col("s")).otherwise(F.col("p"))
    return per.select("job_id", "page", pick.alias("r")).select("job_id", "page", F.col("r.e").alias("engine"), F.when(F.col("r.c") >= 0, F.col("r.c")).alias("confidence"))


#: Rank error of the bracketing sketch as a share of the rows.
SKETCH_ACCURACY = 10_000


def percentiles(df: DataFrame, by: list[str], value: Column, qs: tuple[float, ...]) -> DataFrame:
    """Exact interpolated percentiles per group as array ``p``, and the count ``n``. Mergeable
    sketches bracket each rank, then only the distinct values between the brackets, a share of
    about ``4 / SKETCH_ACCURACY`` of the rows, are put in order: a group of any size is
    aggregated partially twice and never gathered. A null group is a group."""
    keys = [F.col(k).alias(f"_k{i}") for i, k in enumerate(by)] or [F.lit(0).alias("_k0")]  # without groups all rows are one
    names = [f"_k{i}" for i in range(len(keys))]
    rows = df.select(*keys, value.cast("double").alias("_v")).where("_v is not null")
    slack = 2.0 / SKETCH_ACCURACY
    ends = [x for q in qs for x in (max(0.0, q - slack), min(1.0, q + slack))]
    sketch = F.percentile_approx("_v", F.array(*map(F.lit, ends)), F.lit(SKETCH_ACCURACY))
    wanted = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(q).alias("q")) for k, q in enumerate(qs)])
    brackets = rows.groupBy(*names).agg(F.count("*").alias("n"), sketch.alias("e"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    # a bracket at an end of the values must hold the end itself, and that of few values all of them
    few = F.col("n") <= 2 * SKETCH_ACCURACY
    brackets = brackets.select(
        *names, "n", F.transform(wanted, lambda w: F.struct(
            w["k"].alias("k"), (w["q"] * (F.col("n") - 1)).alias("at"),
            F.when(few | (w["q"] <= slack), F.col("lo")).otherwise(F.col("e")[w["k"] * 2]).alias("a"), F.when(few | (w["q"] >= 1 - slack), F.col("hi")).otherwise(F.col("e")[w["k"] * 2 + 1]).alias("b"),
        )).alias("w"))
    same = [F.col(x).eqNullSafe(F.col(f"{x}_")) for x in names]
    right = brackets.select(*[F.col(x).alias(f"{x}_") for x in names], "n", "w")
    # one row a group on the small side
    near = rows.join(right, same).select(*names, "n", "_v", F.explode("w").alias("w"))
    inside = (F.col("_v") >= F.col("w.a")) & (F.col("_v") <= F.col("w.b"))
    counted = near.groupBy(*names, "n", F.col("w.k").alias("k"), F.col("w.at").alias("at"), F.when(inside, F.col("_v")).alias("v")).agg(F.count_if(F.col("_v") < F.col("w.a")).alias("below"), F.count("*").alias("c"))
    per = counted.groupBy(*names, "n", "k", "at").agg(F.sum("below").alias("below"), F.array_sort(F.collect_list(F.when(F.col("v").isNotNull(), F.struct("v", "c")))).alias("vs"))
    # the value at a rank: the first whose cumulated count reaches beyond it
    start = F.struct(F.col("below").alias("seen"), F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"))
    lo = F.floor("at")
    step = lambda z, v: F.struct(
        (z["seen"] + v["c"]).alias("seen"), F.when(z["x"].isNull() & (z["seen"] + v["c"] > lo), v["v"]).otherwise(z["x"]).alias("x"),
        F.when(z["y"].isNull() & (z["seen"] + v["c"] > F.least(lo + 1, F.col("n") - 1)), v["v"]).otherwise(z["y"]).alias("y"),
    )
    got = per.withColumn("z", F.aggregate("vs", start, step)).withColumn("p", F.col("z.x") + (F.col("at") - lo) * (F.col("z.y") - F.col("z.x")))
    out = got.groupBy(*names, "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "p"))), lambda x: x["p"]).alias("p"))
    return out.select(*[F.col(x).alias(k) for x, k in zip(names, by)], "n", "p")


def latency_stats(df: DataFrame, by: str, value: str) -> DataFrame:
    """Exact percentiles, mean, extremes and population deviation."""
    v = measured(F.col(value))
    qs = [("p50", 0.5), ("p75", 0.75), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99)]
    agg = df.groupBy(by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.min(v).alias("least"), F.max(v).alias("most"), F.stddev_pop(v).alias("std"))
    p = percentiles(df, [by], v, tuple(q for _, q in qs)).select(F.col(by).alias("_by"), "p")
    r = lambda c: rounded(F.coalesce(c, F.lit(0.0)))
    both = agg.join(p, F.col(by).eqNullSafe(F.col("_by")), "left")
    return both.select(by, "n", *[r(F.col("p")[k]).alias(n) for k, (n, _) in enumerate(qs)], *[r(F.col(c)).alias(c) for c in ("mean", "least", "most", "std")])


def slopes(df: DataFrame, by: str, order: list[str], value: str, warm_up: int = 0, limit: float = 0.05, bucket: Column | None = None) -> DataFrame:
    """Least-squares slope of ``value`` over the place in order, without the first
    ``warm_up`` rows. A constant series has R2 0; fewer than two points pass with slope 0.
    ``bucket`` grows with the order (the day, say): places are counted by it first."""
    rows = row_numbers(df.where(F.col(value).isNotNull()), [by], F.lit(0) if bucket is None else bucket, order, "x")
    rows = rows.withColumn("x", F.col("x").cast("double")).where(F.col("x") > warm_up)
    y, x = F.col(value), F.col("x")
    fit = rows.groupBy(by).agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("s"), F.regr_intercept(y, x).alias("i"), F.regr_r2(y, x).alias("r"), F.var_pop(y).alias("v"))
    few = F.col("n") < 2
    zero = lambda c: F.round(F.when(few, F.lit(0.0)).otherwise(c), 6)
    return fit.select(
        by, "n", zero(F.col("s")).alias("slope"), zero(F.col("i")).alias("intercept"),
        zero(F.when(F.col("v") <= 1e-12, F.lit(0.0)).otherwise(F.col("r"))).alias("r2"), (few | (F.col("s") <= limit)).alias("passed"),
    )


def resource_summary(df: DataFrame, by: str, at: str, value: str) -> DataFrame:
    """First, last, peak and mean of a measurement, and what it grew by."""
    key = F.struct(at, "id")
    return df.where(F.col(value).isNotNull()).groupBy(by).agg(
        F.count("*").alias("samples"), F.min_by(value, key).alias("first"), F.max(value).alias("peak"), rounded(F.avg(value)).alias("mean"),
        F.round(F.max_by(value, key) - F.min_by(value, key), 4).alias("delta"),
    )


#: Upper bounds of the usual histogram buckets in seconds (fixed values).
BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0)


def histogram(df: DataFrame, by: str, value: str) -> DataFrame:
    """Cumulative buckets: one conditional count each in a single aggregate, then unpivoted."""
    v = measured(F.col(value))
    agg = df.where(v.isNotNull()).groupBy(by).agg(*[F.count_if(v <= b).alias(f"b{k}") for k, b in enumerate(BUCKETS)], F.count("*").alias("inf"))
    rows = F.array(*[F.struct(F.lit(str(b)).alias("le"), F.col(f"b{k}").alias("n")) for k, b in enumerate(BUCKETS)], F.struct(F.lit("+Inf").alias("le"), F.col("inf").alias("n")))
    return agg.select(by, F.explode(rows).alias("x")).select(by, "x.le", F.col("x.n").alias("count"))


def rate_panel(df: DataFrame, at: str, width: str) -> DataFrame:
    """Rows a window of time, and a minute."""
    w = df.where(F.col(at).isNotNull()).groupBy(F.window(at, width).alias("w")).agg(F.count("*").alias("rows"))
    return w.select(F.col("w.start").alias("start"), "rows")


def quantile_panel(df: DataFrame, at: str, width: str, value: str) -> DataFrame:
    rows = df.where(F.col(at).isNotNull()).select(F.window(at, width)["start"].alias("start"), measured(F.col(value)).alias("v"))
    p = percentiles(rows, ["start"], F.col("v"), (0.5, 0.95))
    return p.select("start", rounded(F.col("p")[0]).alias("p50"), rounded(F.col("p")[1]).alias("p95"))


def retained(results: DataFrame, jobs: DataFrame, cutoff: Column) -> DataFrame:
    """Pages without those of jobs that were completed before ``cutoff``."""
    old = jobs.where(F.col("completed_at") < cutoff).select(F.col("id").alias("job_id"))
    return results.join(old, "job_id", "left_anti")


def search(jobs: DataFrame, needle: str) -> DataFrame:
    """Jobs whose file name, status or time of creation holds the needle, without case."""
    n = F.lit(needle.lower())
    hit = lambda c: F.coalesce(F.contains(F.lower(c), n), F.lit(False))
    return jobs.where(hit(F.col("filename")) | hit(F.col("status")) | hit(F.date_format("created_at", "yyyy-MM-dd HH:mm:ss")))


def first_wins(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Union without repetition: of rows with equal keys one of ``first``."""
    both = first.withColumn("_o", F.lit(0)).unionByName(second.withColumn("_o", F.lit(1)))
    rest = [c for c in first.columns if c not in keys]
    return both.groupBy(*keys).agg(F.min(F.struct("_o", *rest)).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def running_total(df: DataFrame, bucket: Column, order: list[str], value: str, by: list[str] | None = None, name: str = "running") -> DataFrame:
    """Sum of ``value`` over all rows (of a group) up to each, in order. ``bucket`` must grow
    with the order: sums of whole buckets are added up first, then a window runs in each
    bucket, so the rows never meet in one task."""
    by = by or []
    b = df.withColumn("_b", bucket)
    per = b.groupBy(*by, "_b").agg(F.sum(value).alias("_s"))
    before = F.sum("_s").over(Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))  # one row per bucket
    offsets = per.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(by)], F.col("_b").alias("_o"), F.coalesce(before, F.lit(0)).alias("_before"))
    w = Window.partitionBy(*by, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(by)] + [F.col("_b").eqNullSafe(F.col("_o"))]
    return b.join(offsets, same).withColumn(name, F.col("_before") + F.sum(value).over(w)).drop("_b", "_o", "_before", *[f"_k{i}" for i in range(len(by))])


def row_numbers(df: DataFrame, by: list[str], bucket: Column, order: list[str], name: str) -> DataFrame:
    """Places from 1 of the rows of each group, in order, counted by buckets that grow with it."""
    return running_total(df.withColumn("_one", F.lit(1)), bucket, order, "_one", by, name).drop("_one")


def pruned(cache: DataFrame, budget: Column, bucket: Column, order: list[str], size: str) -> DataFrame:
    """Oldest entries to delete until the rest fits: those before which it doesn't yet."""
    total = cache.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    run = running_total(cache, bucket, order, size)
    return run.where(F.lit(total) - (F.col("running") - F.col(size)) > budget)


def batches(df: DataFrame, by: str, order: list[str], size: int, bucket: Column | None = None) -> DataFrame:
    """Rows in order cut into batches of ``size`` in each group; ``bucket`` grows with the order
    (the first of it, if none is given)."""
    placed = row_numbers(df, [by], F.col(order[0]) if bucket is None else bucket, order, "batch")
    return placed.withColumn("batch", F.floor((F.col("batch") - 1) / size).cast("bigint"))
