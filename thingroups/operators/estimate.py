"""Approximate AVG, SUM and COUNT."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thingroups.functions import sums
from thingroups.operators.relational import answer, matching_rows
from thingroups.operators.sampling import union_rows
from thingroups.sources.catalog import Catalog
from thingroups.spec import AggQuery


def with_generated(sample: DataFrame, generated: DataFrame | None) -> DataFrame:
    """Sample rows plus generated rows, told apart by ``origin``.

    The whole query still runs over both: a generated row that fails the WHERE
    or finds no dimension row drops out.
    """
    marked = sample.withColumn("origin", F.lit("sample"))
    if generated is None:
        return marked
    return union_rows(marked, generated.withColumn("origin", F.lit("generated")))


def approx_avg(
    catalog: Catalog, query: AggQuery, frames: Mapping[str, DataFrame], generated: DataFrame | None = None
) -> DataFrame:
    """AVG over sampled (and generated) fact rows; dimensions are whole."""
    rows = {**frames, query.table: with_generated(frames[query.table], generated)}
    return answer(catalog, query.with_func("AVG"), rows)


def approx_sum(
    catalog: Catalog,
    query: AggQuery,
    frames: Mapping[str, DataFrame],
    counts: DataFrame,
    sample_rate: float,
    generated: DataFrame | None = None,
    null_share: bool = True,
) -> DataFrame:
    """AVG per group times its estimated row count.

    A group without an estimated count falls back to its sample rows divided by
    the sample rate. Rows whose measure is NULL count as rows but not in the
    AVG; ``null_share`` corrects for their share in the sample.
    """
    rows = {**frames, query.table: with_generated(frames[query.table], generated)}
    x = F.col(query.measure)
    scale = catalog.scale(query.measure, query.table)
    sampled = F.col("origin") == "sample"
    averages = (
        matching_rows(catalog, query, rows)
        .groupBy(F.col(query.group).alias("grp"))
        .agg(
            sums.mean(x, scale).alias("avg_value"),
            F.count(F.when(sampled, F.lit(1))).alias("n_rows"),
            F.count(F.when(sampled, x)).alias("n_measured"),
        )
    )
    share = F.when(F.col("n_rows") > 0, F.col("n_measured") / F.col("n_rows")).otherwise(F.lit(1.0))
    size = F.coalesce(F.col("est_count"), F.col("n_rows") / F.lit(float(sample_rate)))
    value = F.col("avg_value") * size * (share if null_share else F.lit(1.0))
    return averages.join(counts.select("grp", "est_count"), "grp", "left").select("grp", value.alias("value"))


def approx_count(counts: DataFrame) -> DataFrame:
    """Estimated group sizes as the answer."""
    return counts.select("grp", F.col("est_count").alias("value"))


def approx_count_sample(sizes: DataFrame, sample_rate: float) -> DataFrame:
    """Sample rows per group scaled by the rate."""
    return sizes.select("grp", (F.col("n") / F.lit(float(sample_rate))).alias("value"))
