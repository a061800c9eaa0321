"""Joins, set differences and exact aggregation.

No join carries a broadcast hint. Spark broadcasts a side when its measured size
is below ``spark.sql.autoBroadcastJoinThreshold`` and otherwise sorts and merges,
splitting skewed partitions at run time.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thingroups.functions import sums
from thingroups.operators.filters import route, where_all
from thingroups.sources.catalog import Catalog, scan_stored
from thingroups.spec import AggQuery


def full_frames(catalog: Catalog, query: AggQuery) -> dict[str, DataFrame]:
    return {t: scan_stored(catalog, t) for t in catalog.tables_of(query)}


def filtered_frames(catalog: Catalog, query: AggQuery, frames: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Each table after its own predicates, before any join."""
    tables = catalog.tables_of(query)
    routed = route(query.predicates, catalog.specs, tables)
    return {t: where_all(frames[t], routed[t], catalog.spec(t)) for t in tables}


def join_fact_dim(query: AggQuery, fact: DataFrame, dim: DataFrame) -> DataFrame:
    if query.join.fact_key == query.join.dim_key:
        return fact.join(dim, query.join.fact_key, "inner")
    return fact.join(dim, F.col(query.join.fact_key) == F.col(query.join.dim_key), "inner")


def semi_join_reduce(query: AggQuery, fact: DataFrame, filtered_dim: DataFrame) -> DataFrame:
    """Fact rows whose key survives the dimension filter; no survivor, no rows."""
    keys = filtered_dim.select(F.col(query.join.dim_key).alias(query.join.fact_key))
    return fact.join(keys, query.join.fact_key, "left_semi")


def matching_rows(catalog: Catalog, query: AggQuery, frames: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """All rows that satisfy the WHERE, joined if the query joins; no aggregate."""
    parts = filtered_frames(catalog, query, frames or full_frames(catalog, query))
    if query.join is None:
        return parts[query.table]
    return join_fact_dim(query, parts[query.table], parts[query.join.dimension])


def answer(catalog: Catalog, query: AggQuery, frames: Mapping[str, DataFrame]) -> DataFrame:
    """``(grp, value)`` of the query over whichever rows the frames hold."""
    owner = next((t for t in catalog.tables_of(query) if query.measure in catalog.spec(t).kinds), query.table)
    scale = catalog.scale(query.measure, owner)
    if query.join is not None and query.group in (query.join.fact_key, query.join.dim_key) and owner == query.table:
        return _answer_by_key(catalog, query, frames, scale)
    value = sums.aggregate(query.func, F.col(query.measure), scale)
    rows = matching_rows(catalog, query, frames)
    return rows.groupBy(F.col(query.group).alias("grp")).agg(value.alias("value"))


def _answer_by_key(catalog: Catalog, query: AggQuery, frames: Mapping[str, DataFrame], scale: int | None) -> DataFrame:
    """Groups are join keys: add up the fact rows of a key before they meet the dimension,
    so that what is shuffled has one line a key and task, however hot a key is."""
    parts = filtered_frames(catalog, query, frames)
    key, x = query.join.fact_key, F.col(query.measure)
    x = x.cast("double") if scale is None else x.cast(f"decimal(18,{scale})")
    by_key = parts[query.table].groupBy(key).agg(F.sum(x).alias("key_sum"), F.count(x).alias("key_n"))
    joined = join_fact_dim(query, by_key, parts[query.join.dimension])
    total, n = F.sum("key_sum").cast("double"), F.sum("key_n")
    value = {"AVG": F.try_divide(total, n), "SUM": total, "COUNT": n.cast("double")}[query.func]
    return joined.groupBy(F.col(query.group).alias("grp")).agg(value.alias("value"))


def exact(catalog: Catalog, query: AggQuery) -> DataFrame:
    """Ground truth: the query over the whole tables."""
    return answer(catalog, query, full_frames(catalog, query))


def group_sizes(rows: DataFrame, group: str) -> DataFrame:
    return rows.groupBy(F.col(group).alias("grp")).agg(F.count(F.lit(1)).alias("n"))


def coefficient_of_variation(rows: DataFrame, measure: str) -> DataFrame:
    """Sample stddev / mean of one column, as a one-row frame."""
    x = F.col(measure).cast("double")
    return rows.agg(F.try_divide(F.stddev_samp(x), F.avg(x)).alias("cv"))


def left_groups(left: DataFrame, right: DataFrame) -> DataFrame:
    """Groups of ``left`` that ``right`` does not have; NULL is a group like any other."""
    a, b = left.select("grp").alias("a"), right.select("grp").alias("b")
    return a.join(b, F.col("a.grp").eqNullSafe(F.col("b.grp")), "left_anti")


def align(truth: DataFrame, estimate: DataFrame) -> DataFrame:
    """Union of the group keys with both values and who has the group."""
    t = truth.select(F.col("grp").alias("t_grp"), F.col("value").alias("truth"), F.lit(True).alias("t_has"))
    e = estimate.select(F.col("grp").alias("e_grp"), F.col("value").alias("estimate"), F.lit(True).alias("e_has"))
    joined = t.join(e, F.col("t_grp").eqNullSafe(F.col("e_grp")), "full_outer")
    in_truth, in_estimate = F.coalesce("t_has", F.lit(False)), F.coalesce("e_has", F.lit(False))
    return joined.select(
        F.when(in_truth, F.col("t_grp")).otherwise(F.col("e_grp")).alias("grp"),
        "truth",
        "estimate",
        in_truth.alias("in_truth"),
        in_estimate.alias("in_estimate"),
    )
