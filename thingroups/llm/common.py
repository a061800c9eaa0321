"""Helpers shared by the operators: table access, Arrow batches, shared folders."""

from __future__ import annotations

import ctypes
import gc
import os
import uuid
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thingroups.sources.storage import scratch_folder


#: Rows, and bytes of more than one row, that a Python worker holds as Python objects at a time.
ROWS_AT_ONCE, BYTES_AT_ONCE = 2_500, 8_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def on_workers(df: DataFrame) -> DataFrame:
    """Let Python workers of a local session find this package wherever it was started."""
    root = str(Path(__file__).resolve().parents[2])
    known = df.sparkSession.sparkContext.environment
    paths = known.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        known["PYTHONPATH"] = os.pathsep.join(filter(None, [root, *paths]))
    return df


def give_back() -> None:
    """Return freed memory to the system: workers outlive their tasks, and several share a machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # no such call on this system
        pass


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows that are few and small; one row is never cut."""
    pending = [batch.slice(i, ROWS_AT_ONCE) for i in range(0, batch.num_rows, ROWS_AT_ONCE)][::-1]
    while pending:
        part = pending.pop()
        if part.num_rows > 1 and part.nbytes > BYTES_AT_ONCE:
            half = part.num_rows // 2
            pending += [part.slice(half), part.slice(0, half)]
        else:
            yield part


def map_batches(
    df: DataFrame, columns: Sequence[str], work: Callable[[Iterator[list]], Iterator[dict]], schema: str, arrow_in: bool = False
) -> DataFrame:
    """Apply ``work`` to the partitions of the named columns.

    ``work`` gets each Arrow batch as one Python list per column (or, ``arrow_in``,
    one Arrow array) and gives dictionaries of output columns, as lists or arrays.
    Other columns never reach Python.
    """
    target = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = ([c if arrow_in else c.to_pylist() for c in part.columns] for b in batches for part in slices(b))
        for out in work(lists):
            columns = [out[f.name] for f in arrow]
            columns = [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)
        give_back()

    return on_workers(df).select(*columns).mapInArrow(run, schema)


def fold(key: Column, parts: int) -> Column:
    """crc32 of the key as text, modulo ``parts``; NULL keys fall into fold 0."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string")), F.lit(parts)), F.lit(0))


def fresh_folder(spark: SparkSession, what: str) -> str:
    """A new folder below the shared one; never one that another run wrote."""
    return f"{scratch_folder(spark)}/llm/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write to a fresh shared folder and read back: later steps read files, so a
    lost executor costs a re-read and not the whole lineage."""
    path = fresh_folder(df.sparkSession, what)
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
