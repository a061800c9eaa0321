"""Equi-width binning of a numeric column over its [lo, hi] domain.

Bounds may be Python numbers or columns. With numbers the expressions fold to
constants before they reach the scan.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def width(lo, hi, bins: int) -> Column:
    """Bin width, NULL for a constant column."""
    step = (_col(hi) - _col(lo)) / F.lit(bins)
    return F.when(_col(hi) > _col(lo), step)


def edge(lo, hi, bins: int, i) -> Column:
    i = i if isinstance(i, Column) else F.lit(i)
    step = (_col(hi) - _col(lo)) / F.lit(bins)
    return F.when(i == bins, _col(hi)).otherwise(_col(lo) + i * step)


def bin_of(x: Column, lo, hi, bins: int) -> Column:
    """Half-open bins, the last one closed; a constant column has one bin."""
    x = x.cast("double")
    raw = F.floor((x - _col(lo)) / width(lo, hi, bins)).cast("int")
    return F.when(x.isNotNull(), F.least(F.coalesce(raw, F.lit(0)), F.lit(bins - 1)))


def bins_touched(x: Column, lo, hi, bins: int) -> Column:
    """Bins closed on both ends: a value on a shared edge is in two of them."""
    x = x.cast("double")
    home = bin_of(x, lo, hi, bins)
    near = F.filter(
        F.array(home - 1, home, home + 1),
        lambda b: (b >= 0) & (b < bins) & (x >= edge(lo, hi, bins, b)) & (x <= edge(lo, hi, bins, b + 1)),
    )
    one = F.array(F.lit(0))
    return F.when(x.isNotNull(), F.when(_col(hi) > _col(lo), near).otherwise(one))


def boundary_bin(v, lo, hi, bins: int) -> Column:
    """Bin that holds the literal; -1 below the domain, ``bins`` at or above its end."""
    raw = F.floor((_col(v) - _col(lo)) / width(lo, hi, bins)).cast("int")
    return (
        F.when(_col(v) < _col(lo), F.lit(-1))
        .when(_col(v) >= _col(hi), F.lit(bins))
        .otherwise(F.coalesce(raw, F.lit(0)))
    )


# What a bin counts for whose edge alone satisfies a closed comparison: little, but
# no group that lives on the edge is lost.
EDGE_SHARE = 0.01


def boundary_fraction(op: str, v, lo, hi, bins: int) -> Column:
    """Share of the boundary bin that lies on the wanted side of the literal."""
    at = boundary_bin(v, lo, hi, bins)
    step = width(lo, hi, bins)
    left = _col(lo) + step * at
    share = (left + step - _col(v)) / step if op in (">", ">=") else (_col(v) - left) / step
    share = F.least(F.greatest(F.coalesce(share, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    on_edge = at.between(0, bins - 1) & (share == 0)
    return F.when(on_edge, F.lit(EDGE_SHARE)).otherwise(share) if op in (">=", "<=") else share


def full_bins(op: str, v, lo, hi, bins: int) -> tuple[Column, Column]:
    """First and last bin that lie wholly on the wanted side; first > last if none.

    A closed comparison with the end of the domain takes the bin at that end: rows
    with just this value are in it.
    """
    at = boundary_bin(v, lo, hi, bins)
    if op == ">=":
        return F.when(_col(v) == _col(hi), F.lit(bins - 1)).otherwise(at + 1), F.lit(bins - 1)
    if op == ">":
        return at + 1, F.lit(bins - 1)
    return F.lit(0), F.when(_col(v) == _col(lo), F.lit(0)).otherwise(at - 1) if op == "<=" else at - 1


def range_weight(x: Column, op: str, v, lo, hi, bins: int) -> Column:
    """1 in a full bin or at the literal of a closed comparison, the boundary fraction
    in the boundary bin, else 0."""
    if not isinstance(lo, Column) and lo == hi:
        # One-value domain: there is nothing to interpolate.
        satisfied = {">": x > v, ">=": x >= v, "<": x < v, "<=": x <= v}[op]
        return F.when(satisfied, F.lit(1.0)).otherwise(F.lit(0.0))
    home = bin_of(x, lo, hi, bins)
    at = boundary_bin(v, lo, hi, bins)
    inside = home > at if op in (">", ">=") else home < at
    if op in (">=", "<="):
        inside = inside | (x == _col(v))
    return (
        F.when(inside, F.lit(1.0))
        .when(home == at, boundary_fraction(op, v, lo, hi, bins))
        .otherwise(F.lit(0.0))
    )


def weights_of_bins(op: str, v: float, lo: float, hi: float, bins: int, boundary: bool) -> list[float]:
    """Weight of each bin under one comparison: 1 in a full bin, in the boundary bin its share (or,
    without ``boundary``, 0). The same numbers as the columns above, for plans made on the driver."""
    if lo == hi:  # one bin, and nothing to interpolate
        satisfied = {"=": lo == v, ">": lo > v, ">=": lo >= v, "<": lo < v, "<=": lo <= v}[op]
        return [float(satisfied)] * bins
    step = (hi - lo) / bins
    at = -1 if v < lo else bins if v >= hi else math.floor((v - lo) / step)
    if op == "=":
        home = min(math.floor((v - lo) / step), bins - 1) if lo <= v <= hi else -1
        return [float(b == home) for b in range(bins)]
    upwards = op in (">", ">=")
    if upwards:
        first, last = (bins - 1 if op == ">=" and v == hi else at + 1), bins - 1
    else:
        first, last = 0, (0 if op == "<=" and v == lo else at - 1)
    left = lo + step * at
    share = min(max(((left + step - v) if upwards else (v - left)) / step, 0.0), 1.0)
    if op in (">=", "<=") and share == 0:
        share = EDGE_SHARE
    return [1.0 if first <= b <= last else share if boundary and b == at else 0.0 for b in range(bins)]


def weights_of_extremes(op: str, v: float, extremes: dict[int, tuple[float, float]], bins: int) -> list[float]:
    """Weight of each bin under one comparison, from the least and the largest value that it holds: 1 if
    all its values satisfy the comparison, 0 if none does, else the share of the way between
    them. Exact for a bin of one value; an equality counts bins that may hold the literal."""

    def weight(least: float, largest: float) -> float:
        if op == "=":
            return float(least <= v <= largest)
        none = {">": largest <= v, ">=": largest < v, "<": least >= v, "<=": least > v}[op]
        if none:
            return 0.0
        if {">": least > v, ">=": least >= v, "<": largest < v, "<=": largest <= v}[op]:
            return 1.0
        share = (largest - v if op in (">", ">=") else v - least) / (largest - least)
        return min(max(share, EDGE_SHARE), 1.0)

    return [weight(*extremes[b]) if b in extremes else 0.0 for b in range(bins)]


#: Weight of a bin of which only the raw values tell whether they satisfy a comparison.
UNCERTAIN = 0.5


def certainty_of_bins(op: str, v: float, lo: float, hi: float, bins: int) -> list[float]:
    """1 for a bin all of whose values satisfy the comparison, UNCERTAIN where some may, else 0."""
    if lo == hi:
        return weights_of_bins(op, v, lo, hi, bins, False)
    at = -1 if v < lo else bins if v > hi else min(math.floor((v - lo) / ((hi - lo) / bins)), bins - 1)
    beyond = {">": 1, ">=": 1, "<": -1, "<=": -1, "=": 0}[op]
    return [UNCERTAIN if b == at else 1.0 if (b - at) * beyond > 0 else 0.0 for b in range(bins)]
