"""Typed predicates and their routing to the table that owns the column."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from decimal import ROUND_FLOOR, Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thingroups.spec import Predicate, TableSpec


def literal(value, kind: str, dtype: T.DataType | None = None) -> Column:
    """The literal in the type of its column, so that it can be pushed to the scan."""
    if kind == "str":
        return F.lit(str(value))
    if kind == "int":
        return F.lit(int(Decimal(str(value))))
    if isinstance(dtype, T.DecimalType):
        return F.lit(Decimal(str(value)))
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.lit(str(value)).cast(dtype)
    return F.lit(float(value))


def compare(left: Column, op: str, right: Column) -> Column:
    return {
        "=": lambda: left == right,
        ">": lambda: left > right,
        ">=": lambda: left >= right,
        "<": lambda: left < right,
        "<=": lambda: left <= right,
    }[op]()


def compare_whole(left: Column, op: str, value) -> Column:
    """Compare a column of whole numbers: a fraction moves the bound to the next whole one."""
    exact = Decimal(str(value))
    below = int(exact.to_integral_value(ROUND_FLOOR))
    if exact == below:
        return compare(left, op, F.lit(below))
    if op == "=":
        return left.isNull() & left.isNotNull()
    return left > F.lit(below) if op in (">", ">=") else left <= F.lit(below)


def condition(df: DataFrame, predicate: Predicate, spec: TableSpec) -> Column:
    kind = spec.kinds[predicate.column]
    if kind == "int":
        return compare_whole(F.col(predicate.column), predicate.op, predicate.value)
    value = literal(predicate.value, kind, df.schema[predicate.column].dataType)
    return compare(F.col(predicate.column), predicate.op, value)


def conjunction(df: DataFrame, predicates: Iterable[Predicate], spec: TableSpec) -> Column:
    return reduce(lambda a, b: a & b, [condition(df, p, spec) for p in predicates], F.lit(True))


def where_all(df: DataFrame, predicates: Iterable[Predicate], spec: TableSpec) -> DataFrame:
    """AND of all predicates as plain comparisons, which reach the Parquet scan."""
    for predicate in predicates:
        df = df.where(condition(df, predicate, spec))
    return df


def route(
    predicates: Iterable[Predicate], specs: Mapping[str, TableSpec], tables: Iterable[str]
) -> dict[str, list[Predicate]]:
    """Split predicates by the table that declares their column."""
    routed: dict[str, list[Predicate]] = {t: [] for t in tables}
    for predicate in predicates:
        owners = [t for t in routed if predicate.column in specs[t].kinds]
        if not owners:
            raise ValueError(f"no table of the query has a column '{predicate.column}'")
        for owner in owners:
            routed[owner].append(predicate)
    return routed


def drop_incomplete(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df.na.drop(subset=columns)
