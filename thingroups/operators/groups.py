"""Which groups exist, and how large they are."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thingroups.functions import binning
from thingroups.functions.numbers import as_number, number_of
from thingroups.operators import bitmaps, factors
from thingroups.operators.factors import Factor
from thingroups.operators.filters import compare, compare_whole, condition, route, where_all
from thingroups.operators.relational import filtered_frames, left_groups, semi_join_reduce
from thingroups.sources.catalog import Catalog, scan_bernoulli, scan_stored
from thingroups.operators.sampling import in_sample
from thingroups.sources.storage import BitmapIndex, cut
from thingroups.spec import AggQuery, Predicate

missing_groups = left_groups


def index_rows(catalog: Catalog, query: AggQuery, index: BitmapIndex | None = None, seed: int = 42) -> DataFrame:
    """Fact rows the index covers: its row table if there is one, else the same draw again."""
    return index.rows() if index is not None else scan_bernoulli(catalog, query.table, seed=seed)


def _joined(catalog: Catalog, query: AggQuery, rows: DataFrame) -> DataFrame:
    if query.join is None:
        return rows
    dim = query.join.dimension
    predicates = route(query.predicates, catalog.specs, catalog.tables_of(query))[dim]
    return semi_join_reduce(query, rows, where_all(scan_stored(catalog, dim), predicates, catalog.spec(dim)))


def _fact_predicates(catalog: Catalog, query: AggQuery):
    return route(query.predicates, catalog.specs, catalog.tables_of(query))[query.table]


# --- from rows -------------------------------------------------------------


def group_counts(
    catalog: Catalog,
    query: AggQuery,
    mode: str = "interpolate",
    bins: int = 100,
    rows: DataFrame | None = None,
    seed: int = 42,
) -> DataFrame:
    """Predicted groups and their estimated row counts ``(grp, est_count)``.

    One scan with partial aggregation; nothing but group totals is shuffled.

    * ``interpolate``: a row counts 1 in a bin that lies wholly inside a range
      predicate, the covered fraction in the boundary bin;
    * ``exact``: predicates are evaluated on the row;
    * ``reference``: full bins only, plus the fraction of rows that sit exactly
      on the edge shared with the boundary bin.
    """
    spec, rate = catalog.spec(query.table), catalog.spec(query.table).index_rate
    rows = scan_bernoulli(catalog, query.table, seed=seed) if rows is None else rows
    bounds = catalog.bounds(query.table)
    weight, extra = F.lit(1.0), F.lit(0.0)
    for p in _fact_predicates(catalog, query):
        if mode == "exact" or not p.is_range or spec.kinds[p.column] != "num" or p.column not in bounds:
            rows = where_all(rows, [p], spec)
            continue
        dtype = catalog.frame(query.table).schema[p.column].dataType
        (lo, hi), v, x = bounds[p.column], number_of(p.value, dtype), as_number(F.col(p.column), dtype)
        if mode == "interpolate":
            weight = weight * binning.range_weight(x, p.op, v, lo, hi, bins)
            # Weights are zero beyond the boundary bin: say so in a form the scan understands.
            margin = 2 * (hi - lo) / bins
            rows = rows.where(x >= v - margin if p.op in (">", ">=") else x <= v + margin)
        elif mode == "reference":
            at = binning.boundary_bin(v, lo, hi, bins)
            share = binning.boundary_fraction(p.op, v, lo, hi, bins)
            first, last = binning.full_bins(p.op, v, lo, hi, bins)
            shared = binning.edge(lo, hi, bins, first if p.op in (">", ">=") else last + 1)
            rows = rows.where((first <= last) & (x >= shared if p.op in (">", ">=") else x <= shared))
            extra = extra + F.when((x == shared) & at.between(0, bins - 1), share).otherwise(F.lit(0.0))
        else:
            raise ValueError(f"unknown count mode '{mode}'")
    total = F.sum(weight + extra) / F.lit(float(rate))
    if query.join is not None and query.group == query.join.fact_key:
        # Groups are join keys: count first, then drop the keys without a dimension row.
        by_key = rows.groupBy(query.group).agg(total.alias("est_count"))
        counted = _joined(catalog, query, by_key).withColumnRenamed(query.group, "grp")
    else:
        counted = _joined(catalog, query, rows).groupBy(F.col(query.group).alias("grp")).agg(total.alias("est_count"))
    return counted.where(F.col("grp").isNotNull() & (F.col("est_count") > 0))


def group_row_ids(catalog: Catalog, query: AggQuery, rows: DataFrame) -> DataFrame:
    """``(grp, rid)`` of every index row that satisfies the query, predicates on raw values."""
    spec = catalog.spec(query.table)
    kept = _joined(catalog, query, where_all(rows, _fact_predicates(catalog, query), spec))
    return kept.select(F.col(query.group).alias("grp"), "rid")


def candidate_rows(catalog: Catalog, query: AggQuery, rows: DataFrame) -> DataFrame:
    """Index rows that satisfy the query: where top-up draws from."""
    return _joined(catalog, query, where_all(rows, _fact_predicates(catalog, query), catalog.spec(query.table)))


# --- from bitmaps ----------------------------------------------------------


def _dimension_rows(catalog: Catalog, query: AggQuery) -> DataFrame:
    """The rows of the dimension that satisfy its predicates."""
    dim = query.join.dimension
    predicates = route(query.predicates, catalog.specs, catalog.tables_of(query))[dim]
    return where_all(scan_stored(catalog, dim), predicates, catalog.spec(dim))


def _by_column(predicates) -> dict[str, list[Predicate]]:
    out: dict[str, list[Predicate]] = {}
    for p in predicates:
        out.setdefault(p.column, []).append(p)
    return out


def _matching(containers: DataFrame, predicates: list[Predicate], kind: str) -> DataFrame:
    """Containers of a column whose value satisfies all predicates, in a form that the scan understands."""
    for p in predicates:
        if kind == "str":
            if p.is_range:
                raise ValueError(f"range predicate on text column '{p.column}'")
            containers = containers.where(F.col("value") == str(p.value))
        elif kind == "num":
            containers = containers.where(compare(F.col("real"), p.op, F.lit(float(p.value))))
        else:
            number = F.coalesce("number", F.expr("try_cast(value AS bigint)"))
            containers = containers.where(compare_whole(number, p.op, p.value))
            exact = Decimal(str(p.value))
            if p.op == "=" and exact == int(exact):
                containers = containers.where(F.col("value") == str(int(exact)))
            else:  # pushed to the scan: a bound on the stored numbers
                containers = containers.where(F.col("number").isNull() | compare_whole(F.col("number"), p.op, p.value))
    return containers


def query_factors(catalog: Catalog, query: AggQuery, index: BitmapIndex, boundary: str = factors.FULL) -> list[Factor]:
    """The WHERE (and the join) as one factor a column. Dimension predicates are read from the
    join index if it is there, and then neither the dimension nor the foreign key is."""
    spec, bounds = index.spec, catalog.bounds(query.table)
    out = []
    for column, predicates in _by_column(_fact_predicates(catalog, query)).items():
        if spec.kinds[column] != "num":
            out.append(factors.values_factor(_matching(index.read(column), predicates, spec.kinds[column])))
        elif column in bounds:
            dtype = catalog.frame(query.table).schema[column].dataType
            numbered = [Predicate(column, p.op, number_of(p.value, dtype)) for p in predicates]
            extremes = index.bin_extremes(column) if boundary == factors.TIGHT else None
            weights = factors.bin_weights(numbered, *bounds[column], index.bins, boundary, extremes)
            out.append(factors.steps_factor(index.slices(column), weights))
        else:  # all NULL
            out.append(factors.values_factor(index.read(column)))
    if query.join is not None:
        present = index.joined(query.join)
        if present is None:
            keys = _dimension_rows(catalog, query).select(F.col(query.join.dim_key).cast("string").alias("value"))
            out.append(factors.values_factor(index.read(query.join.fact_key).join(keys, "value", "left_semi")))
        else:
            dim = query.join.dimension
            routed = _by_column(route(query.predicates, catalog.specs, catalog.tables_of(query))[dim])
            kinds = catalog.spec(dim).kinds
            for column, predicates in routed.items():
                out.append(factors.values_factor(_matching(index.joined(query.join, column), predicates, kinds[column])))
            if not routed:
                out.append(factors.values_factor(present))
    return out


def query_set(catalog: Catalog, query: AggQuery, index: BitmapIndex) -> DataFrame | None:
    """Row set of the WHERE (and of the join) out of the index; ``None`` means all rows."""
    if index.packed:
        found = query_factors(catalog, query, index)
        return factors.row_set(found) if found else None
    keys = None
    if query.join is not None:
        keys = (query.join.fact_key, _dimension_rows(catalog, query).select(query.join.dim_key))
    return bitmaps.conjunction_set(
        index.read(), _fact_predicates(catalog, query), index.spec, catalog.bounds(query.table), index.bins, keys
    )


def _typed(catalog: Catalog, query: AggQuery, counted: DataFrame) -> DataFrame:
    dtype = catalog.frame(query.table).schema[query.group].dataType
    return counted.select(F.col("value").cast(dtype).alias("grp"), *[c for c in counted.columns if c != "value"])


def predict_groups(catalog: Catalog, query: AggQuery, index: BitmapIndex) -> DataFrame:
    """Groups whose bitmap meets the row set of the query, with the size of the overlap."""
    if index.packed:
        found = query_factors(catalog, query, index)
        groups = index.read(query.group)
        if found:
            counted = factors.count_groups(groups, found).select("value", "n")
        else:
            counted = groups.groupBy("value").agg(F.sum("n").alias("n"))
        return _typed(catalog, query, counted)
    inside = query_set(catalog, query, index)
    return _typed(catalog, query, bitmaps.counts_within(index.read(query.group), inside))


def bitmap_group_counts(catalog: Catalog, query: AggQuery, index: BitmapIndex, tight: bool = False) -> DataFrame:
    """``(grp, est_count)`` by bitmap algebra alone.

    A packed index interpolates: a row counts with the product of its bins' weights, all
    in one pass over the containers; ``tight`` interpolates between the values that a
    bin holds, which is exact where it holds one. On a closed index the boundary bin of each range predicate is
    intersected with rows that are already inside the full bins, so it adds the edge rows.
    """
    if index.packed:
        found = query_factors(catalog, query, index, factors.TIGHT if tight else factors.SHARE)
        groups = index.read(query.group)
        if found:
            counted = factors.count_groups(groups, found).select("value", "weight")
        else:
            counted = groups.groupBy("value").agg(F.sum("n").cast("double").alias("weight"))
        rated = counted.select("value", (F.col("weight") / index.spec.index_rate).alias("est_count"))
        return _typed(catalog, query, rated)
    inside, bounds = query_set(catalog, query, index), catalog.bounds(query.table)
    groups = index.read(query.group)
    parts = [bitmaps.counts_within(groups, inside).select("value", F.col("n").cast("double").alias("n"))]
    for p in _fact_predicates(catalog, query):
        if p.is_range and index.spec.kinds[p.column] == "num":
            lo, hi = bounds[p.column]
            border = bitmaps.intersect([inside, bitmaps.boundary_set(index.read(), p, bounds, index.bins)])
            share = binning.boundary_fraction(p.op, float(p.value), lo, hi, index.bins)
            parts.append(bitmaps.counts_within(groups, border).select("value", (F.col("n") * share).alias("n")))
    total = reduce(DataFrame.unionByName, parts).groupBy("value").agg(F.sum("n").alias("n"))
    return _typed(catalog, query, total.select("value", (F.col("n") / index.spec.index_rate).alias("est_count")))


def index_row_ids(catalog: Catalog, query: AggQuery, index: BitmapIndex) -> DataFrame:
    """``(grp, rid)`` of the rows that satisfy the query, out of a packed index. Only rows of
    boundary bins are fetched, to see their values."""
    found = query_factors(catalog, query, index, factors.UNCERTAIN)
    ids = cut(factors.row_ids_of(index.read(query.group), found))
    unsure = ids.where(~F.col("certain"))
    seen = where_all(index.fetch(unsure), _fact_predicates(catalog, query), index.spec).select("rid")
    kept = ids.where("certain").unionByName(unsure.join(seen, "rid", "left_semi").select(*ids.columns))
    return _typed(catalog, query, kept.select("value", "rid"))


def sample_mark(rate: float, seed: int) -> str:
    return f"sample_{rate}_{seed}"


def topup_from_index(
    catalog: Catalog, query: AggQuery, index: BitmapIndex, rare: DataFrame, sample_rate: float, seed: int = 42
) -> DataFrame:
    """Up to ``need`` random rows outside the sample for every rare group ``(grp, need)``, chosen on
    the index: in each bucket the rows of lowest draw among group AND where AND NOT sample, then
    the lowest of all buckets. Only these rows are fetched; those of boundary bins that turn
    out not to satisfy the query leave their place to the next.

    A row's draw is a hash of its id. The mark of the sample is written on first use."""
    index.write_mark(sample_mark(sample_rate, seed), lambda rows: in_sample(rows, index.spec, sample_rate, seed))
    found = query_factors(catalog, query, index, factors.UNCERTAIN)
    found.append(factors.values_factor(index.mark(sample_mark(sample_rate, seed)), negated=True))
    needs = rare.where(F.col("grp").isNotNull()).select(F.col("grp").cast("string").alias("value"), F.col("need").cast("int").alias("need"))
    groups = index.read(query.group).join(needs, "value")
    picked = cut(factors.pick_rows(groups, found, seed))
    by_draw = Window.partitionBy("value").orderBy("draw", "rid")
    ranked = picked.where("certain").withColumn("at", F.row_number().over(by_draw)).where(F.col("at") <= F.col("need"))
    last = ranked.where(F.col("at") == F.col("need")).select("value", F.col("draw").alias("last"))
    chosen = picked.join(last, "value", "left").where(F.col("last").isNull() | (F.col("draw") <= F.col("last")))
    chosen = cut(chosen.select("rid", "draw", "need"))
    rows = where_all(index.fetch(chosen), _fact_predicates(catalog, query), index.spec).join(chosen, "rid")
    lowest = Window.partitionBy(query.group).orderBy("draw", "rid")
    drawn = rows.withColumn("at", F.row_number().over(lowest)).where(F.col("at") <= F.col("need"))
    return drawn.select(*index.spec.stored_columns)


def bitmap_op_count(catalog: Catalog, query: AggQuery, index: BitmapIndex) -> DataFrame:
    """AND / OR operations a prediction takes: bins, predicates, keys, groups, boundaries."""
    spec, bounds = index.spec, catalog.bounds(query.table)
    predicates = _fact_predicates(catalog, query)
    ops, boundary = F.lit(len(predicates)), F.lit(0)
    for p in predicates:
        if p.is_range and spec.kinds[p.column] == "num":
            lo, hi = bounds[p.column]
            first, last = binning.full_bins(p.op, float(p.value), lo, hi, index.bins)
            at = binning.boundary_bin(float(p.value), lo, hi, index.bins)
            ops = ops + F.greatest(last - first + 1, F.lit(0))
            boundary = boundary + F.when(at.between(0, index.bins - 1), 1).otherwise(0)
    groups = index.read(query.group).agg(F.count_distinct("value").cast("bigint").alias("n"))
    predicted = predict_groups(catalog, query, index).agg((F.count(F.lit(1)) * boundary).cast("bigint").alias("n"))
    counts = [groups.select((F.col("n") + ops).cast("bigint").alias("n")), predicted]
    for p in predicates:
        if p.is_range and spec.kinds[p.column] == "int":
            mine = index.read(p.column).select(F.col("value").cast("bigint").alias(p.column)).distinct()
            counts.append(mine.where(condition(mine, p, spec)).agg(F.count(F.lit(1)).alias("n")))
    if query.join is not None:
        dim = query.join.dimension
        parts = filtered_frames(catalog, query, {query.table: scan_stored(catalog, query.table), dim: scan_stored(catalog, dim)})
        keys = parts[dim].select(F.col(query.join.dim_key).cast("string").alias("value")).distinct()
        present = index.read(query.join.fact_key).select("value").distinct().join(keys, "value", "left_semi")
        counts.append(present.agg(F.count(F.lit(1)).alias("n")))
    return reduce(DataFrame.unionByName, counts).agg(F.sum("n").alias("bitmap_ops"))
