"""Row sets and group counts out of bitmap containers, in one pass over the buckets.

A WHERE is a product of factors, one a column. A factor names the containers to read and
the weight of a row by how many of them hold it. For a numeric column all its predicates make one
weight a bin (1 in a full bin, the covered share in a boundary bin), a step function:
with nested sets "rows up to bin b" at its steps, the number of sets that hold a row
tells its step. Each such set is a fine and a coarse slice, so that a range reads at most
two containers a step and bucket, however many bins it covers.

All containers of a query, those of the groups among them, meet by bucket, each read once
and with its role. Nothing but totals of groups, or one bitmap a bucket, leaves a bucket.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thingroups.functions import binning
from thingroups.functions.arrow import apply_arrow
from thingroups.operators.packing import (
    BUCKET_ROWS, COARSE, FINE, as_bitmap, block_size, row_ids, unpacked, whole_column,
)
from thingroups.spec import Predicate

GROUP = -1


@dataclass(frozen=True)
class Factor:
    """``containers`` (bucket, times, bitmap, positions), and the weight of a row met 0, 1, ... times."""

    containers: DataFrame
    weights: tuple[float, ...]


def values_factor(containers: DataFrame, negated: bool = False) -> Factor:
    """Rows in any of the containers, or in none of them."""
    lines = containers.select("bucket", F.lit(1).alias("times"), "bitmap", "positions")
    return Factor(lines, (1.0, 0.0) if negated else (0.0, 1.0))


#: What a boundary bin counts: nothing, the covered share of its width, a mark that its rows need a
#: look, or the covered share of the way between its least and its largest value.
FULL, SHARE, UNCERTAIN, TIGHT = "full", "share", "uncertain", "tight"


def bin_weights(
    predicates: Sequence[Predicate], lo: float, hi: float, bins: int, boundary: str, extremes: dict[int, tuple[float, float]] | None = None
) -> list[float]:
    """Weight of each bin under all predicates of a numeric column."""
    weights = [1.0] * bins
    for p in predicates:
        if boundary == TIGHT:
            one = binning.weights_of_extremes(p.op, float(p.value), extremes or {}, bins)
        elif boundary == UNCERTAIN:
            one = binning.certainty_of_bins(p.op, float(p.value), lo, hi, bins)
        else:
            one = binning.weights_of_bins(p.op, float(p.value), lo, hi, bins, boundary == SHARE)
        weights = [a * b for a, b in zip(weights, one, strict=True)]
    return weights


def steps_factor(slices: DataFrame, weights: Sequence[float]) -> Factor:
    """The factor of a numeric column, out of its slices and the weights of its bins."""
    bins, block = len(weights), block_size(len(weights))
    steps = [b for b in range(bins) if b == bins - 1 or weights[b] != weights[b + 1]]
    if weights[-1] == 0:
        steps.pop()  # rows beyond the last step are held by no set, as are NULLs
    wanted: Counter = Counter()
    for b in steps:
        whole = (b + 1) % block == 0
        before = b // block + 1 if whole else b // block
        if before:
            wanted[COARSE, before] += 1
        if not whole:
            wanted[FINE, b] += 1
    times, any_ = F.lit(0), F.lit(False)
    for (level, at), n in sorted(wanted.items()):
        holds = (F.col("level") == level) & (F.col("first") <= at) & (F.col("last") >= at)
        if level == FINE:
            holds = holds & (F.col("first") >= at // block * block)
        times, any_ = times + F.when(holds, n).otherwise(0), any_ | holds
    lines = slices.where(any_).select("bucket", times.alias("times"), "bitmap", "positions")
    return Factor(lines, (0.0, *[weights[b] for b in reversed(steps)]))


def _tagged(factors: Sequence[Factor], groups: DataFrame | None, *more: str) -> DataFrame:
    nulls = [F.lit(None).cast("string").alias("value"), *[F.lit(None).cast("int").alias(c) for c in more]]
    parts = [f.containers.select("bucket", F.lit(i).alias("role"), "times", *nulls, "bitmap", "positions") for i, f in enumerate(factors)]
    if groups is not None:
        parts.append(groups.select("bucket", F.lit(GROUP).alias("role"), F.lit(1).alias("times"), "value", *more, "bitmap", "positions"))
    return reduce(DataFrame.unionByName, parts)


def row_weights(table: pa.Table, tables: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The weight of every row of a bucket; with the positions of all containers and their owners."""
    roles = table.column("role").to_numpy()
    times = table.column("times").to_numpy()
    positions, owner = unpacked(table)
    weights = np.ones(BUCKET_ROWS)
    for i, by_times in enumerate(tables):
        mine = roles[owner] == i
        met = np.bincount(positions[mine], times[owner[mine]], BUCKET_ROWS).astype(np.int64)
        weights = weights * by_times[np.minimum(met, len(by_times) - 1)]
    return weights, positions, owner


def count_groups(groups: DataFrame, factors: Sequence[Factor]) -> DataFrame:
    """(value, n, weight) of each value's rows that have any weight: how many, and their weights."""
    tables = [np.array(f.weights) for f in factors]

    def work(table: pa.Table) -> list:
        weights, positions, owner = row_weights(table, tables)
        mine = table.column("role").to_numpy()[owner] == GROUP
        positions, owner = positions[mine], owner[mine]
        total = np.bincount(owner, weights[positions], table.num_rows)
        n = np.bincount(owner, weights[positions] > 0, table.num_rows).astype(np.int64)
        some = np.flatnonzero(n)
        return [whole_column(table, "value").take(pa.array(some)), pa.array(n[some]), pa.array(total[some])]

    found = apply_arrow(_tagged(factors, groups), "bucket", work, "value string, n long, weight double")
    return found.groupBy("value").agg(F.sum("n").alias("n"), F.sum("weight").alias("weight"))


def row_set(factors: Sequence[Factor]) -> DataFrame:
    """(bucket, bitmap) of the rows that have any weight; no line for a bucket without one."""
    tables = [np.array(f.weights) for f in factors]

    def work(table: pa.Table) -> list:
        weights, *_ = row_weights(table, tables)
        rows = np.flatnonzero(weights)
        kept = [as_bitmap(rows)] if len(rows) else []
        return [whole_column(table, "bucket").slice(0, len(kept)), pa.array(kept, pa.binary())]

    return apply_arrow(_tagged(factors, None), "bucket", work, "bucket long, bitmap binary")



def draws(rids: np.ndarray, seed: int) -> np.ndarray:
    """A random order of row ids: 63 bits that depend on the id and the seed alone."""
    x = rids.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> np.uint64(shift)) * np.uint64(factor)
    return ((x ^ x >> np.uint64(31)) >> np.uint64(1)).astype(np.int64)


def pick_rows(groups: DataFrame, factors: Sequence[Factor], seed: int) -> DataFrame:
    """(value, need, rid, draw, certain): for each container of a group, which comes with the number of
    rows its group needs, the rows of lowest draw. ``certain`` rows have weight 1; of the others, which
    may drop out when their values are seen, those before the last certain one are taken as well."""
    tables = [np.array(f.weights) for f in factors]

    def work(table: pa.Table) -> list:
        weights, positions, owner = row_weights(table, tables)
        mine = (table.column("role").to_numpy()[owner] == GROUP) & (weights[positions] > 0)
        positions, owner = positions[mine], owner[mine]
        rids = row_ids(table.column("bucket")[0].as_py(), positions)
        draw, certain = draws(rids, seed), weights[positions] == 1
        order = np.lexsort((draw, owner))
        rids, draw, certain, owner = rids[order], draw[order], certain[order], owner[order]
        before = np.cumsum(certain) - certain
        before = before - before[np.searchsorted(owner, owner)]
        need = table.column("need").fill_null(0).to_numpy()[owner]
        keep = np.flatnonzero(before < need)
        return [
            whole_column(table, "value").take(pa.array(owner[keep])), pa.array(need[keep], pa.int32()),
            pa.array(rids[keep]), pa.array(draw[keep]), pa.array(certain[keep]),
        ]

    lines = _tagged(factors, groups, "need")
    return apply_arrow(lines, "bucket", work, "value string, need int, rid long, draw long, certain boolean")


def row_ids_of(groups: DataFrame, factors: Sequence[Factor]) -> DataFrame:
    """(value, rid, certain) of all rows of the groups that have any weight."""
    tables = [np.array(f.weights) for f in factors]

    def work(table: pa.Table) -> list:
        weights, positions, owner = row_weights(table, tables)
        mine = (table.column("role").to_numpy()[owner] == GROUP) & (weights[positions] > 0)
        positions, owner = positions[mine], owner[mine]
        rids = row_ids(table.column("bucket")[0].as_py(), positions)
        return [whole_column(table, "value").take(pa.array(owner)), pa.array(rids), pa.array(weights[positions] == 1)]

    return apply_arrow(_tagged(factors, groups), "bucket", work, "value string, rid long, certain boolean")
