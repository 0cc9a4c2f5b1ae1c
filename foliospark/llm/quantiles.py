"""Problem 7: percentiles per group over very many values, with a known bound on the error.

A summary is a sorted list of tuples ``(value, least rank, greatest rank)`` with the number
of values and the accumulated rank error. Every task keeps one summary per group and
compresses it: a tuple goes where its neighbours leave a rank interval within the permitted
uncertainty. Summaries merge in two rounds (``FAN`` partial merges a group, then their
merge), so a group of any size never meets in one task but as ``FAN`` bounded lists. Ranks
of a merge are the sums of the ranks in its parts, so the bound that comes out is the true
one; summaries of days, tables or partitions combine in the same way.

Null, NaN, infinite and negative values aren't measurements and are left out. Groups
without measurements have no row; a null key is a group of its own. Ties keep their ranks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType, _parse_datatype_string

from .base import require

#: Permitted rank uncertainty as a share of the number of values.
EPSILON = 0.001
#: Partial merges of a group.
FAN = 64
#: Values a task holds for all its groups before it writes summaries and begins anew.
HELD = 2_000_000

_REST = "n bigint, rank_error bigint, vals array<double>, least array<bigint>, greatest array<bigint>"


class Summary:
    __slots__ = ("n", "vals", "least", "greatest")

    def __init__(self, n, vals, least, greatest):
        self.n, self.vals, self.least, self.greatest = n, vals, least, greatest

    @classmethod
    def of(cls, values: np.ndarray) -> Summary:
        v = np.sort(values)
        ranks = np.arange(1, len(v) + 1)
        return cls(len(v), v, ranks, ranks)

    def error(self) -> int:
        """Most ranks by which the best tuple can miss any rank asked for."""
        if len(self.vals) < 2:
            return int(self.n - 1) // 2 if self.n > 1 else 0
        return int(max((self.greatest[1:] - self.least[:-1]).max() // 2, (self.greatest - self.least).max()))

    def compress(self, epsilon: float) -> Summary:
        """Keep tuples so that neighbours leave at most ``2 * epsilon * n`` ranks between them."""
        room = int(2 * epsilon * self.n)
        if room < 2 or len(self.vals) <= 2:
            return self
        keep, last, m = [0], 0, len(self.vals)
        while last < m - 1:
            # the farthest tuple that is still within the room, at least the next
            nxt = int(np.searchsorted(self.greatest, self.least[last] + room, side="right")) - 1
            last = min(max(nxt, last + 1), m - 1)
            keep.append(last)
        return Summary(self.n, self.vals[keep], self.least[keep], self.greatest[keep])

    @staticmethod
    def merge(parts: list[Summary]) -> Summary:
        parts = [p for p in parts if p.n]
        if len(parts) == 1:
            return parts[0]
        owner = np.concatenate([np.full(len(p.vals), k) for k, p in enumerate(parts)])
        vals = np.concatenate([p.vals for p in parts])
        order = np.lexsort((owner, vals))
        owner, vals = owner[order], vals[order]
        least = np.zeros(len(vals), dtype=np.int64)
        greatest = np.zeros(len(vals), dtype=np.int64)
        for k, p in enumerate(parts):
            before = np.cumsum(owner == k)  # own tuples up to and with each place
            mine = owner == k
            lo = np.concatenate([[0], p.least])
            hi = np.concatenate([p.greatest - 1, [p.n]])
            least += np.where(mine, p.least[np.maximum(before - 1, 0)], lo[before])
            greatest += np.where(mine, p.greatest[np.maximum(before - 1, 0)], hi[before])
        return Summary(sum(p.n for p in parts), vals, least, greatest)

    def at(self, q: float) -> tuple[float, int]:
        """(value for the rank ``ceil(q * n)``, most ranks by which it can be wrong)."""
        rank = min(max(int(np.ceil(q * self.n)), 1), self.n)
        off = np.maximum(rank - self.least, self.greatest - rank)
        k = int(np.argmin(off))
        return float(self.vals[k]), int(max(off[k], 0))


def _fields(df: DataFrame, keys: list[str]) -> list[StructField]:
    return [df.schema[k] for k in keys]


def _emit(keys, groups: dict, arrow, extra=()) -> pa.RecordBatch:
    ks = list(groups)
    cols = [[k[i] for k in ks] for i in range(len(keys))] + [[x] * len(ks) for x in extra]
    s = [groups[k] for k in ks]
    cols += [[x.n for x in s], [x.error() for x in s], [x.vals.tolist() for x in s], [x.least.tolist() for x in s], [x.greatest.tolist() for x in s]]
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, arrow)], schema=arrow)


def summaries(df: DataFrame, keys: list[str], value: str, epsilon: float = EPSILON) -> DataFrame:
    """One summary per group of ``keys``: a table that can be stored and merged later."""
    v = F.col(f"`{value}`").cast("double")
    rows = require(df, *dict.fromkeys([*keys, value])).where(v.isNotNull() & ~F.isnan(v) & (v >= 0) & (v < float("inf")))
    rows = rows.select(*[F.col(f"`{k}`") for k in keys], v.alias("_value"))
    schema = StructType([*_fields(rows, keys), StructField("_part", LongType())] + list(_parse_datatype_string(_REST)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        arrow, part = to_arrow_schema(schema), TaskContext.get().partitionId()
        held: dict[tuple, list[np.ndarray]] = {}
        done: dict[tuple, Summary] = {}
        size = 0
        for b in batches:
            values = b.column(len(keys)).to_numpy(zero_copy_only=False)
            for key, at in _grouped([b.column(i) for i in range(len(keys))], len(values)):
                held.setdefault(key, []).append(values[at])
            size += len(values)
            if size >= HELD:
                _fold(held, done, epsilon)
                size = sum(len(s.vals) for s in done.values())
                if size >= HELD // 2:
                    yield _emit(keys, done, arrow, (part,))
                    done, size = {}, 0
        _fold(held, done, epsilon)
        if done:
            yield _emit(keys, done, arrow, (part,))

    return _merged(rows.mapInArrow(run, schema), keys, epsilon)


def _grouped(cols: list[pa.Array], n: int) -> Iterator[tuple[tuple, np.ndarray]]:
    """(key, places) of each group of a batch: keys become codes, and the codes are sorted."""
    codes = np.zeros(n, dtype=np.int64)
    for c in cols:
        d = c.dictionary_encode(null_encoding="encode")
        codes = codes * max(1, len(d.dictionary)) + d.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(codes, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(codes[order])) + 1):
        if len(at):
            yield tuple(c[int(at[0])].as_py() for c in cols), at


def _fold(held: dict, done: dict, epsilon: float) -> None:
    for key, arrays in held.items():
        s = Summary.of(np.concatenate(arrays)).compress(epsilon / 4)
        done[key] = Summary.merge([done[key], s]).compress(epsilon / 4) if key in done else s
    held.clear()


def _merged(parts: DataFrame, keys: list[str], epsilon: float) -> DataFrame:
    salted = parts.withColumn("_part", F.pmod("_part", F.lit(FAN)))
    return _round(_round(salted, [*keys, "_part"], epsilon / 4).drop("_part"), keys, epsilon / 4)


def _round(parts: DataFrame, keys: list[str], epsilon: float) -> DataFrame:
    """Merge the summaries with equal ``keys``: sorted within partitions, streamed."""
    cols = [*keys, "n", "vals", "least", "greatest"]
    near = parts.select(*cols)
    near = near.repartition(*[F.col(f"`{k}`") for k in keys]).sortWithinPartitions(*[F.col(f"`{k}`") for k in keys]) if keys else near.coalesce(1)
    schema = StructType(_fields(near, keys) + list(_parse_datatype_string(_REST)))
    m = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        key, open_, out = None, [], {}
        for b in batches:
            data = [c.to_pylist() for c in b.columns]
            for row in zip(*data):
                k = row[:m]
                if open_ and k != key:
                    out[key] = Summary.merge(open_).compress(epsilon)
                    open_ = []
                key = k
                open_.append(Summary(row[m], *[np.array(x) for x in row[m + 1 :]]))
                if len(open_) > FAN:
                    open_ = [Summary.merge(open_).compress(epsilon)]
            if len(out) > 1000:
                yield _emit(keys, out, arrow)
                out = {}
        if open_:
            out[key] = Summary.merge(open_).compress(epsilon)
        if out:
            yield _emit(keys, out, arrow)

    return near.mapInArrow(run, schema)


def combine(stored: DataFrame, keys: list[str], epsilon: float = EPSILON) -> DataFrame:
    """Summaries of finer groups (days, tables) combined into those of ``keys``."""
    salted = stored.withColumn("_part", F.pmod(F.monotonically_increasing_id(), F.lit(FAN)))
    return _merged(salted, keys, epsilon)


def percentiles(stored: DataFrame, keys: list[str], qs: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """Row per group: ``n``, ``p50, p90, ...`` and ``rank_error``, the greatest of their bounds."""
    names = [f"p{round(q * 100, 3):g}".replace(".", "_") for q in qs]
    schema = StructType(_fields(stored, keys) + list(_parse_datatype_string("n bigint, rank_error bigint, " + ", ".join(f"{x} double" for x in names))))
    m = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        for b in batches:
            rows = []
            for row in zip(*[c.to_pylist() for c in b.columns]):
                s = Summary(row[m], *[np.array(x) for x in row[m + 1 :]])
                got = [s.at(q) for q in qs]
                rows.append((*row[:m], s.n, max(e for _, e in got), *[x for x, _ in got]))
            cols = list(zip(*rows)) if rows else [()] * len(arrow)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, arrow)], schema=arrow)

    return stored.select(*keys, "n", "vals", "least", "greatest").mapInArrow(run, schema)


def within(df: DataFrame, keys: list[str], value: str, epsilon: float, qs: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """Percentiles from summaries of ``epsilon`` held against the values themselves: per group
    ``n``, for each percentile whether its true rank lies within the reported error, and
    whether that error is within what ``epsilon`` permits."""
    if not keys:
        raise ValueError("no keys to hold percentiles against values by")
    got = percentiles(summaries(df, keys, value, epsilon), keys, qs)
    names = got.columns[len(keys) + 2 :]
    v = F.col(f"`{value}`").cast("double")
    rows = require(df, *dict.fromkeys([*keys, value])).where(v.isNotNull() & ~F.isnan(v) & (v >= 0) & (v < float("inf"))).select(*keys, v.alias("_value"))
    right = got.toDF(*[f"_k{i}" for i in range(len(keys))], *got.columns[len(keys) :])
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    both = rows.join(right, same)  # one row a group on the right
    counts = [F.count_if(F.col("_value") < F.col(x)).alias(f"_lo_{x}") for x in names] + [F.count_if(F.col("_value") <= F.col(x)).alias(f"_hi_{x}") for x in names]
    ranks = both.groupBy(*keys, "n", "rank_error").agg(*counts)
    rank = lambda q: F.least(F.greatest(F.ceil(F.lit(q) * F.col("n")), F.lit(1)), F.col("n"))
    holds = [((F.col(f"_lo_{x}") + 1 - F.col("rank_error") <= rank(q)) & (rank(q) <= F.col(f"_hi_{x}") + F.col("rank_error"))).alias(f"{x}_within") for x, q in zip(names, qs)]
    return ranks.select(*keys, "n", *holds, (F.col("rank_error") <= F.greatest(F.lit(1.0), F.lit(2 * epsilon) * F.col("n"))).alias("error_within"))
