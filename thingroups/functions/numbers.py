"""Dates and timestamps as numbers: days and seconds since 1970, as doubles."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TIMES = (T.TimestampType, T.TimestampNTZType)


def as_number(x: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.DateType):
        return F.unix_date(x).cast("double")
    if isinstance(dtype, TIMES):
        return F.unix_micros(x.cast("timestamp")) / F.lit(1e6)
    return x.cast("double")


def from_number(x: Column, dtype: T.DataType) -> Column:
    """The date, timestamp or number that stands for a double."""
    if isinstance(dtype, T.DateType):
        return F.date_from_unix_date(F.floor(x).cast("int"))
    if isinstance(dtype, TIMES):
        return F.timestamp_micros(F.round(x * F.lit(1e6)).cast("bigint")).cast(dtype)
    return x.cast(dtype)


def number_of(value, dtype: T.DataType) -> float:
    """A literal as the number that columns of its type are compared by; Spark reads dates and times
    in the session's time zone."""
    if not isinstance(dtype, (T.DateType, *TIMES)):
        return float(value)
    line = SparkSession.active().range(1).select(as_number(F.lit(str(value)).cast(dtype), dtype).alias("x")).first()
    return line["x"]
