"""Bitmap index: per column and value (or numeric bin), the set of row ids.

Row ids fall into buckets of 32,768. A container is the set of one value in one
bucket. A crowded container is stored as a bitmap, a thin one as a short list
of positions, so the index grows with rows x columns and not with the number of
distinct values, and empty containers do not exist.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thingroups.functions import binning
from thingroups.operators.filters import compare_whole, literal
from thingroups.spec import Predicate, TableSpec

BITMAP_BYTES = 4096
# A position takes two bytes: from here on the bitmap is the smaller form.
DENSE_FROM = BITMAP_BYTES // 2

Bounds = Mapping[str, tuple[float, float]]


# --- building --------------------------------------------------------------


def entries(
    rows: DataFrame,
    spec: TableSpec,
    bounds: Bounds,
    bins: int = 100,
    closed: bool = False,
    columns: Sequence[str] | None = None,
    rid: str = "rid",
) -> DataFrame:
    """``(column, value, bucket, position)`` for every row and indexed column.

    A numeric value is represented by its bin. ``closed`` bins include both
    edges, so a value on a shared edge is entered twice.
    """
    columns = list(columns or spec.columns)

    def cell(name: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("column"), value.cast("string").alias("value"))

    def cells_of(name: str, values: Column) -> Column:
        return F.transform(values, lambda value: cell(name, value))

    single, several = [], []
    for name in columns:
        if spec.kinds[name] != "num":
            single.append(cell(name, F.col(name)))
        elif name not in bounds:
            continue  # an all-NULL column has no bins
        elif closed:
            lo, hi = bounds[name]
            touched = F.coalesce(
                binning.bins_touched(F.col(name), lo, hi, bins), F.array().cast("array<int>")
            )
            several.append(cells_of(name, touched))
        else:
            lo, hi = bounds[name]
            single.append(cell(name, binning.bin_of(F.col(name), lo, hi, bins)))
    cells = F.array(*single)
    if several:
        cells = F.concat(cells, *several) if single else F.concat(*several)
    return (
        rows.select(
            F.bitmap_bucket_number(F.col(rid)).alias("bucket"),
            F.bitmap_bit_position(F.col(rid)).cast("short").alias("position"),
            F.inline(cells),
        )
        .where(F.col("value").isNotNull())
        .select("column", "value", "bucket", "position")
    )


def build(lines: DataFrame, layout: str = "adaptive") -> DataFrame:
    """Containers ``(column, value, bucket, n, bitmap, positions)`` out of entries.

    ``layout`` is ``adaptive`` or ``dense`` (bitmaps only, for columns with few
    values). Rows of a task share their buckets, so containers are complete
    before the shuffle except at task borders.
    """
    key = ["column", "value", "bucket"]
    no_positions = F.lit(None).cast("array<smallint>").alias("positions")
    position = F.col("position").cast("bigint")
    if layout == "dense":
        made = lines.groupBy(*key).agg(F.bitmap_construct_agg(position).alias("bitmap"))
        return made.select(*key, F.bitmap_count("bitmap").cast("int").alias("n"), "bitmap", no_positions)
    if layout != "adaptive":
        raise ValueError(f"unknown layout '{layout}'")
    # A leading hash makes the grouping sort cheap: the texts share long prefixes.
    spread = F.xxhash64(*key).alias("spread")
    packed = lines.groupBy(spread, *key).agg(F.collect_list("position").alias("positions"))
    packed = packed.withColumn("n", F.size("positions"))
    thin = packed.where(F.col("n") < DENSE_FROM).select(
        *key, "n", F.lit(None).cast("binary").alias("bitmap"), F.sort_array("positions").alias("positions")
    )
    # Same grouping key, so the second aggregation needs no further shuffle.
    crowded = (
        packed.where(F.col("n") >= DENSE_FROM)
        .select("spread", *key, F.explode("positions").alias("position"))
        .groupBy("spread", *key)
        .agg(F.bitmap_construct_agg(position).alias("bitmap"), F.count(F.lit(1)).cast("int").alias("n"))
        .select(*key, "n", "bitmap", no_positions)
    )
    return thin.unionByName(crowded)


# --- row sets --------------------------------------------------------------


def union_set(containers: DataFrame) -> DataFrame:
    """OR of all given containers: one ``(bucket, bitmap)`` line per non-empty bucket."""
    crowded = containers.where(F.col("bitmap").isNotNull()).select("bucket", "bitmap")
    thin = (
        containers.where(F.col("positions").isNotNull())
        .select("bucket", F.explode("positions").alias("position"))
        .groupBy("bucket")
        .agg(F.bitmap_construct_agg(F.col("position").cast("bigint")).alias("bitmap"))
    )
    return crowded.unionByName(thin).groupBy("bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def equal_set(index: DataFrame, predicate: Predicate, spec: TableSpec, bounds: Bounds, bins: int = 100) -> DataFrame:
    """Rows with ``column = value``; an unknown value gives the empty set.

    On a numeric column this is the bin of the literal.
    """
    kind = spec.kinds[predicate.column]
    wanted = literal(predicate.value, kind)
    if kind == "num":
        lo, hi = bounds[predicate.column]
        wanted = F.when(
            wanted.between(lo, hi), binning.bin_of(F.lit(float(predicate.value)), lo, hi, bins)
        )
    mine = index.where((F.col("column") == predicate.column) & (F.col("value") == wanted.cast("string")))
    return union_set(mine)


def range_set(index: DataFrame, predicate: Predicate, spec: TableSpec, bounds: Bounds, bins: int = 100) -> DataFrame:
    """OR of the bins that lie wholly on the wanted side of the literal.

    Integer categorical columns have no bins; their values are compared exactly.
    """
    mine = index.where(F.col("column") == predicate.column)
    if spec.kinds[predicate.column] == "int":
        return union_set(mine.where(compare_whole(F.col("value").cast("bigint"), predicate.op, predicate.value)))
    if spec.kinds[predicate.column] == "str":
        raise ValueError(f"range predicate on text column '{predicate.column}'")
    lo, hi = bounds[predicate.column]
    first, last = binning.full_bins(predicate.op, float(predicate.value), lo, hi, bins)
    return union_set(mine.where(F.col("value").cast("int").between(first, last)))


def boundary_set(index: DataFrame, predicate: Predicate, bounds: Bounds, bins: int = 100) -> DataFrame:
    """Rows of the bin that holds the literal of a range predicate."""
    lo, hi = bounds[predicate.column]
    at = binning.boundary_bin(float(predicate.value), lo, hi, bins)
    return union_set(index.where((F.col("column") == predicate.column) & (F.col("value") == at.cast("string"))))


def predicate_set(index: DataFrame, predicate: Predicate, spec: TableSpec, bounds: Bounds, bins: int = 100) -> DataFrame:
    make = range_set if predicate.is_range else equal_set
    return make(index, predicate, spec, bounds, bins)


def key_set(index: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """OR over the surviving dimension keys; no key, empty set."""
    wanted = keys.select(F.col(keys.columns[0]).cast("string").alias("value")).distinct()
    return union_set(index.where(F.col("column") == column).join(wanted, "value", "left_semi"))


def intersect(sets: Sequence[DataFrame]) -> DataFrame | None:
    """AND of row sets; ``None`` (all rows) for no set at all.

    A set without a line for a bucket is empty there, so only buckets to which
    every set contributed survive.
    """
    if not sets:
        return None
    if len(sets) == 1:
        return sets[0]
    lines = reduce(DataFrame.unionByName, sets)
    both = lines.groupBy("bucket").agg(F.bitmap_and_agg("bitmap").alias("bitmap"), F.count(F.lit(1)).alias("sets"))
    return both.where((F.col("sets") == len(sets)) & (F.bitmap_count("bitmap") > 0)).select("bucket", "bitmap")


def conjunction_set(
    index: DataFrame,
    predicates: Sequence[Predicate],
    spec: TableSpec,
    bounds: Bounds,
    bins: int = 100,
    join_keys: tuple[str, DataFrame] | None = None,
) -> DataFrame | None:
    """Row set of a WHERE, with the dimension folded in as a set of foreign keys."""
    sets = [predicate_set(index, p, spec, bounds, bins) for p in predicates]
    if join_keys is not None:
        sets.append(key_set(index, *join_keys))
    return intersect(sets)


def set_size(rows: DataFrame) -> DataFrame:
    return rows.agg(F.coalesce(F.sum(F.bitmap_count("bitmap")), F.lit(0)).alias("n"))


# --- groups within a row set ----------------------------------------------


def _bit_is_set(mask: Column, position: Column) -> Column:
    octet = F.conv(F.hex(F.substring(mask, (position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("bigint")
    return F.getbit(octet, (position % 8).cast("int")) == 1


def counts_within(containers: DataFrame, rows: DataFrame | None) -> DataFrame:
    """``(value, n)``: rows of each value inside the set, empty intersections left out.

    Both sides meet on the bucket. Thin containers are first packed into one
    line per bucket (at most 32,768 positions), so the set's bitmap is read once
    per bucket and not once per value; a bucket has at most 16 crowded ones.
    """
    if rows is None:
        return containers.groupBy("value").agg(F.sum("n").alias("n"))
    mask = rows.select("bucket", F.col("bitmap").alias("mask"))
    packed = (
        containers.where(F.col("positions").isNotNull())
        .groupBy("bucket")
        .agg(F.collect_list(F.struct("value", "positions")).alias("items"))
    )
    hits = F.transform(
        "items",
        lambda item: F.struct(
            item["value"].alias("value"),
            F.size(F.filter(item["positions"], lambda p: _bit_is_set(F.col("mask"), p))).alias("n"),
        ),
    )
    thin = packed.join(mask, "bucket").select(F.inline(F.filter(hits, lambda h: h["n"] > 0)))
    crowded = (
        containers.where(F.col("bitmap").isNotNull())
        .select("bucket", "value", "bitmap")
        .join(mask, "bucket")
        .select("bucket", "value", F.explode(F.array("bitmap", "mask")).alias("bitmap"))
        .groupBy("bucket", "value")
        .agg(F.bitmap_count(F.bitmap_and_agg("bitmap")).alias("n"))
        .where(F.col("n") > 0)
        .select("value", "n")
    )
    return thin.unionByName(crowded).groupBy("value").agg(F.sum("n").alias("n"))


# --- reports ---------------------------------------------------------------


def storage_stats(index: DataFrame) -> DataFrame:
    """Per column: containers of either form, rows, and bytes of the three layouts."""
    is_dense = F.col("bitmap").isNotNull()
    return index.groupBy("column").agg(
        F.count_distinct("value").alias("n_values"),
        F.count(F.lit(1)).alias("containers"),
        F.sum(is_dense.cast("bigint")).alias("dense_containers"),
        F.sum(F.col("n").cast("bigint")).alias("entries"),
        F.sum(F.when(is_dense, F.lit(BITMAP_BYTES)).otherwise(F.col("n") * 2).cast("bigint")).alias("adaptive_bytes"),
        (F.count(F.lit(1)) * BITMAP_BYTES).alias("dense_bytes"),
        F.sum(F.col("n").cast("bigint") * 2).alias("list_bytes"),
    )
