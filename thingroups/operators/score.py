"""Scores of an estimate against the exact answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thingroups.operators.relational import align, left_groups

EPSILON = 1e-8


def _error() -> Column:
    off = F.abs(F.col("truth") - F.col("estimate")) / (F.abs("truth") + F.lit(EPSILON))
    both = F.col("in_truth") & F.col("in_estimate")
    return F.coalesce(F.when(both, F.least(F.lit(1.0), off)), F.lit(1.0))


def group_errors(truth: DataFrame, estimate: DataFrame) -> DataFrame:
    """Capped relative error per group; 1 where either side lacks the group or a value."""
    return align(truth, estimate).select("grp", "truth", "estimate", _error().alias("error"))


def score(truth: DataFrame, estimate: DataFrame) -> DataFrame:
    """All scores in one row: one join on the group, one aggregation.

    An empty estimate scores error 1, precision 1, recall 0.
    """
    both = F.col("in_truth") & F.col("in_estimate")
    counted = align(truth, estimate).agg(
        F.avg(_error()).alias("error"),
        F.count(F.when(both, 1)).alias("tp"),
        F.count(F.when(F.col("in_estimate") & ~F.col("in_truth"), 1)).alias("fp"),
        F.count(F.when(F.col("in_truth") & ~F.col("in_estimate"), 1)).alias("fn"),
    )
    nothing = F.col("tp") + F.col("fp") == 0
    per_truth = F.col("tp") + F.col("fn")

    def over_truth(n: str) -> Column:
        return F.when(per_truth > 0, F.col(n) / per_truth).otherwise(F.lit(0.0))

    return counted.select(
        F.when(nothing, F.lit(1.0)).otherwise(F.col("error")).alias("relative_error"),
        F.when(nothing, F.lit(1.0)).otherwise(F.try_divide("tp", F.col("tp") + F.col("fp"))).alias("precision"),
        over_truth("tp").alias("recall"),
        over_truth("fn").alias("missing_rate"),
        over_truth("fp").alias("out_rate"),
        "tp",
        "fp",
        "fn",
    )


def out_groups(truth: DataFrame, estimate: DataFrame) -> DataFrame:
    return left_groups(estimate, truth)


def lost_groups(truth: DataFrame, estimate: DataFrame) -> DataFrame:
    return left_groups(truth, estimate)


def true_negatives(domain: DataFrame, truth: DataFrame, estimate: DataFrame) -> DataFrame:
    """Groups of the domain that neither side has."""
    return left_groups(left_groups(domain, truth), estimate)
