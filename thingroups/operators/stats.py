"""Catalog statistics: domains, bounds, frequencies, normalisation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thingroups.functions import sums
from thingroups.functions.numbers import as_number
from thingroups.spec import TableSpec


def long_form(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """One ``(keep.., column, value)`` line per row and column, values as text."""
    texts = [F.col(c).cast("string").alias(f"cell_{c}") for c in columns]
    wide = df.select(*keep, *texts)
    lines = wide.unpivot(list(keep), [f"cell_{c}" for c in columns], "column", "value")
    return lines.withColumn("column", F.substr("column", F.lit(len("cell_") + 1)))


def domain_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct values (NULL included) of all columns in one pass."""
    return long_form(df, columns).distinct()


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows per value and column; NULL cells are not counted."""
    lines = long_form(df, columns).where(F.col("value").isNotNull())
    return lines.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def cardinality(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """Distinct non-NULL values per column."""
    if approximate:
        counts = df.agg(*[F.approx_count_distinct(c).alias(c) for c in columns])
        return counts.unpivot([], list(columns), "column", "n_values")
    # Distinct first, then count: two partially aggregated shuffles on
    # (column, value), instead of one task per column holding its whole domain.
    return domain_values(df, columns).groupBy("column").agg(F.count("value").alias("n_values"))


def numeric_bounds(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, lo, hi)`` of every numeric column from one aggregation; of dates and timestamps, days and seconds."""
    pairs = [
        F.struct(
            F.lit(c).alias("column"),
            F.min(as_number(F.col(c), df.schema[c].dataType)).alias("lo"),
            F.max(as_number(F.col(c), df.schema[c].dataType)).alias("hi"),
        )
        for c in columns
    ]
    return df.agg(F.array(*pairs).alias("pairs")).select(F.inline("pairs"))


def norm_stats(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Mean and sample stddev per numeric column; categorical columns get 0 and 1."""
    numeric = [
        F.struct(
            F.lit(c).alias("column"),
            sums.mean(F.col(c), spec.scales.get(c)).alias("mean"),
            F.stddev_samp(F.col(c).cast("double")).alias("std"),
        )
        for c in spec.numeric
    ]
    fixed = [
        F.struct(F.lit(c).alias("column"), F.lit(0.0).alias("mean"), F.lit(1.0).alias("std"))
        for c in spec.categorical
    ]
    return df.agg(F.array(*numeric, *fixed).alias("rows")).select(F.inline("rows"))


def lookup_unique(values: DataFrame, column: str) -> DataFrame:
    """Domain of one column out of :func:`domain_values`; empty if unknown."""
    return values.where(F.col("column") == column).select("value")


def lookup_minmax(bounds: DataFrame, column: str) -> DataFrame:
    """Bounds of one column out of :func:`numeric_bounds`; empty if unknown."""
    return bounds.where(F.col("column") == column).select("lo", "hi")
