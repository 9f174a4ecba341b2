"""Python work on rows in small slices of Arrow batches, so that a worker's memory doesn't follow the batch size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

ROWS_AT_ONCE = 128


def map_rows(df: DataFrame, function: Callable[[list[dict]], list[dict]], schema: StructType, rows_at_once: int = ROWS_AT_ONCE) -> DataFrame:
    """``function`` turns a list of rows into a list of rows of ``schema``; it sees at most ``rows_at_once`` rows."""
    out = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows_at_once):
                yield pa.RecordBatch.from_pylist(function(batch.slice(at, rows_at_once).to_pylist()), schema=out)

    return df.mapInArrow(run, schema)
