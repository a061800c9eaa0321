"""Order-independent sums and averages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(x: Column, scale: int | None = None) -> Column:
    """Sum as double; in decimal underneath when the scale is declared."""
    if scale is None:
        return F.sum(x.cast("double"))
    return F.sum(x.cast(f"decimal(18,{scale})")).cast("double")


def mean(x: Column, scale: int | None = None) -> Column:
    if scale is None:
        return F.avg(x.cast("double"))
    return F.try_divide(total(x, scale), F.count(x))


def aggregate(func: str, x: Column, scale: int | None = None) -> Column:
    if func == "AVG":
        return mean(x, scale)
    if func == "SUM":
        return total(x, scale)
    return F.count(x).cast("double")


def spread_ratio(n: Column, s1: Column, s2: Column, center: Column) -> Column:
    """Sample stddev / mean from moments taken around ``center``.

    ``n`` rows, ``s1`` the sum and ``s2`` the sum of squares of ``x - center``.
    NULL below two rows or at mean zero, so that a comparison with it fails.
    """
    rows = F.nullif(n, F.lit(0))
    variance = (s2 - s1 * s1 / rows) / F.nullif(n - 1, F.lit(0))
    return F.sqrt(F.greatest(variance, F.lit(0.0))) / F.nullif(center + s1 / rows, F.lit(0.0))
