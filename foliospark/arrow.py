"""Arrow batch maps for the few operators that no expression can state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string


def map_batches(df: DataFrame, make: Callable[[], Callable[..., list[tuple]]], schema: str) -> DataFrame:
    """Arrow map without pandas: ``make()`` runs once per task and returns a function that
    takes the columns of a batch as lists and returns the result rows as tuples."""
    out = _parse_datatype_string(schema)
    assert isinstance(out, StructType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(out)
        fn = make()
        for b in batches:
            rows = fn(*[c.to_pylist() for c in b.columns])
            cols = list(zip(*rows)) if rows else [()] * len(arrow)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, arrow)], schema=arrow)

    return df.mapInArrow(run, out)
