"""Rows with large nested values through Python, a few at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

SLICE = 128


def map_rows(df: DataFrame, f: Callable[[dict], list[dict]], schema: str, size: int = SLICE) -> DataFrame:
    """The rows that ``f`` makes of each row.

    An Arrow batch holds ten thousand rows, whatever their size; only ``size``
    of them are turned into Python objects at once.
    """
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                yield pa.RecordBatch.from_pylist([x for row in batch.slice(at, size).to_pylist() for x in f(row)], schema=arrow)

    return df.mapInArrow(run, schema)
