"""Joins, set differences and exact aggregation."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.common import (
    ESTIMATE, FLAG_COUNTS, FLAG_WHERE, FLAGSHIP, IN_SAMPLE, ITEM_IN_SAMPLE, ITEM_WHERE, ITEMS, PRIORITIES,
    STAR, STAR_COUNT, STAR_COUNT_FROM, STAR_FROM, TAIL_COUNTS, TAIL_TRUTH, TRUTH, catalog, check, mean,
    predicted_and_sizes, sampled, total, truth_and_sample, truth_and_tail,
)
from thingroups.functions import sums
from thingroups.operators import relational
from thingroups.operators.groups import missing_groups as absent_groups
from thingroups.operators.relational import exact, filtered_frames, full_frames, join_fact_dim
from thingroups.operators.score import lost_groups as lost
from thingroups.operators.score import out_groups as extra


@check(
    "join_fact_dim",
    "SELECT l_returnflag, s_nationkey, COUNT(*) AS n, "
    + total("l_quantity")
    + " AS qty FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2",
)
def fact_dim(spark, sf):
    frames = full_frames(catalog(spark, sf), STAR)
    rows = join_fact_dim(STAR, frames["lineitem"], frames["supplier"])
    return rows.groupBy("l_returnflag", "s_nationkey").agg(
        F.count(F.lit(1)).alias("n"), sums.total(F.col("l_quantity"), 2).alias("qty")
    )


@check(
    "join_sampled_fact_full_dim",
    "SELECT l_suppkey, s_nationkey, COUNT(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey"
    f" WHERE s_nationkey = 3 AND l_discount >= 0.05 AND {ITEM_IN_SAMPLE} GROUP BY 1, 2",
)
def sampled_fact(spark, sf):
    frames = sampled(catalog(spark, sf), STAR)
    rows = join_fact_dim(STAR, frames["lineitem"], frames["supplier"])
    return rows.groupBy("l_suppkey", "s_nationkey").agg(F.count(F.lit(1)).alias("n"))


@check(
    "semi_join_reduce",
    "SELECT l_suppkey, COUNT(*) AS n FROM lineitem WHERE l_discount >= 0.05 AND l_suppkey IN"
    " (SELECT s_suppkey FROM supplier WHERE s_nationkey = 3) GROUP BY 1",
)
def semi_join(spark, sf):
    cat = catalog(spark, sf)
    parts = filtered_frames(cat, STAR, full_frames(cat, STAR))
    rows = relational.semi_join_reduce(STAR, parts["lineitem"], parts["supplier"])
    return rows.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))


@check("missing_groups", f"WITH {FLAG_COUNTS} SELECT grp FROM counts WHERE grp NOT IN (SELECT grp FROM ({ESTIMATE}))")
def missing(spark, sf):
    return absent_groups(*predicted_and_sizes(catalog(spark, sf)))


@check("out_groups", f"WITH {TAIL_COUNTS} SELECT grp FROM counts WHERE grp NOT IN (SELECT grp FROM ({TAIL_TRUTH}))")
def out_groups(spark, sf):
    return extra(*truth_and_tail(catalog(spark, sf)))


@check("lost_groups", f"SELECT grp FROM ({TRUTH}) WHERE grp NOT IN (SELECT grp FROM ({ESTIMATE}))")
def lost_groups(spark, sf):
    return lost(*truth_and_sample(catalog(spark, sf)))


@check(
    "align_truth_estimate",
    "SELECT coalesce(t.grp, e.grp) AS grp, t.value AS truth, e.value AS estimate, t.grp IS NOT NULL AS in_truth,"
    f" e.grp IS NOT NULL AS in_estimate FROM ({TRUTH}) t FULL OUTER JOIN ({ESTIMATE}) e ON t.grp = e.grp",
)
def align_truth_estimate(spark, sf):
    return relational.align(*truth_and_sample(catalog(spark, sf)))


def _exact(name, query, sql):
    @check(name, sql)
    def run(spark, sf):
        return exact(catalog(spark, sf), query)


_exact("exact_avg", FLAGSHIP, TRUTH)
_exact(
    "exact_sum",
    ITEMS,
    f"SELECT l_partkey AS grp, {total('l_extendedprice')} AS value FROM lineitem WHERE {ITEM_WHERE} GROUP BY 1",
)
_exact(
    "exact_count", PRIORITIES, "SELECT o_orderpriority AS grp, COUNT(o_totalprice)::DOUBLE AS value FROM orders GROUP BY 1"
)
_exact("exact_avg_join", STAR, f"SELECT l_returnflag AS grp, {mean('l_quantity')} AS value FROM {STAR_FROM} GROUP BY 1")
_exact(
    "exact_sum_join",
    STAR.with_func("SUM"),
    f"SELECT l_returnflag AS grp, {total('l_quantity')} AS value FROM {STAR_FROM} GROUP BY 1",
)
_exact(
    "exact_count_join",
    STAR_COUNT,
    f"SELECT l_suppkey AS grp, COUNT(l_quantity)::DOUBLE AS value FROM {STAR_COUNT_FROM} GROUP BY 1",
)


@check(
    "group_sizes", f"SELECT user_id AS grp, COUNT(*) AS n FROM events WHERE {FLAG_WHERE} AND {IN_SAMPLE} GROUP BY 1"
)
def sizes(spark, sf):
    return predicted_and_sizes(catalog(spark, sf))[1]


@check(
    "coefficient_of_variation",
    f"SELECT round(stddev_samp(value) / avg(value), 6) AS cv FROM events WHERE {FLAG_WHERE} AND {IN_SAMPLE}",
)
def cv(spark, sf):
    rows = sampled(catalog(spark, sf), FLAGSHIP)["events"]
    return relational.coefficient_of_variation(rows, "value").select(F.round("cv", 6).alias("cv"))
