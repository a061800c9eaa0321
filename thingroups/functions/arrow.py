"""Arrow batches on Spark's Python workers, for what no built-in function expresses."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame


def on_workers(df: DataFrame) -> DataFrame:
    """Let Python workers of a local session find this package wherever it was started."""
    root = str(Path(__file__).resolve().parents[2])
    known = df.sparkSession.sparkContext.environment
    paths = known.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        known["PYTHONPATH"] = os.pathsep.join(filter(None, [root, *paths]))
    return df


def arrow_schema(df: DataFrame, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)


def map_arrow(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[list]], schema: str) -> DataFrame:
    """``work`` over the batches of a partition; it gives lists of Arrow arrays in the order of ``schema``."""
    arrow = arrow_schema(df, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in work(batches):
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return on_workers(df).mapInArrow(run, schema)


def apply_arrow(df: DataFrame, key: str, work: Callable[[pa.Table], list], schema: str) -> DataFrame:
    """``work`` over all rows of each key, as one table; it gives Arrow arrays as above."""
    arrow = arrow_schema(df, schema)

    def run(table: pa.Table) -> pa.Table:
        return pa.Table.from_arrays(work(table.combine_chunks()), schema=arrow)

    return on_workers(df).groupBy(key).applyInArrow(run, schema)
