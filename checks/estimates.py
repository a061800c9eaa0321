"""Approximate AVG, SUM and COUNT."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.common import (
    ESTIMATE, FLAG_COUNTS, FLAG_WHERE, FLAGSHIP, IN_SAMPLE, ITEM_COUNTS, ITEM_IN_SAMPLE, ITEM_WHERE, ITEMS, RATE,
    STAR, STAR_FROM, catalog, check, mean, predicted_and_sizes, sampled,
)
from thingroups.operators import estimate
from thingroups.operators.groups import group_counts
from thingroups.spec import AggQuery, Predicate


@check("approx_avg", ESTIMATE)
def approx_avg(spark, sf):
    cat = catalog(spark, sf)
    return estimate.approx_avg(cat, FLAGSHIP, sampled(cat, FLAGSHIP))


@check(
    "approx_avg_join",
    f"SELECT l_returnflag AS grp, {mean('l_quantity')} AS value FROM {STAR_FROM} AND {ITEM_IN_SAMPLE} GROUP BY 1",
)
def approx_avg_join(spark, sf):
    cat = catalog(spark, sf)
    return estimate.approx_avg(cat, STAR, sampled(cat, STAR))


@check(
    "approx_avg_with_generated",
    f"SELECT user_id AS grp, {mean('value')} AS value FROM (SELECT user_id, value, event_type FROM events"
    f" WHERE {FLAG_WHERE} AND {IN_SAMPLE} UNION ALL SELECT user_id, 30.0, event_type FROM events WHERE value > 100)"
    f" WHERE {FLAG_WHERE} GROUP BY 1",
)
def with_generated(spark, sf):
    # Extra rows pass through the whole query, so those of other types drop out.
    cat = catalog(spark, sf)
    extra = cat.frame("events").where("value > 100").select("user_id", "event_type", F.lit(30.0).alias("value"))
    return estimate.approx_avg(cat, FLAGSHIP, sampled(cat, FLAGSHIP), extra)


@check(
    "approx_sum",
    f"WITH {ITEM_COUNTS} SELECT a.grp, round(a.value * est_count, 4) AS value FROM (SELECT l_partkey AS grp,"
    f" {mean('l_extendedprice')} AS value FROM lineitem WHERE {ITEM_WHERE} AND {ITEM_IN_SAMPLE} GROUP BY 1) a"
    " JOIN counts USING (grp)",
)
def approx_sum(spark, sf):
    cat = catalog(spark, sf)
    answered = estimate.approx_sum(cat, ITEMS, sampled(cat, ITEMS), group_counts(cat, ITEMS), RATE)
    return answered.select("grp", F.round("value", 4).alias("value"))


@check(
    "approx_sum_fallback",
    f"SELECT l_partkey AS grp, round({mean('l_extendedprice')} * (COUNT(*) / 0.1::DOUBLE), 4) AS value FROM lineitem"
    f" WHERE {ITEM_WHERE} AND {ITEM_IN_SAMPLE} GROUP BY 1",
)
def approx_sum_fallback(spark, sf):
    # No group has a predicted count: every one falls back to its scaled sample rows.
    cat = catalog(spark, sf)
    none = group_counts(cat, ITEMS).where(F.lit(False))
    answered = estimate.approx_sum(cat, ITEMS, sampled(cat, ITEMS), none, RATE)
    return answered.select("grp", F.round("value", 4).alias("value"))


@check(
    "approx_sum_null_share",
    f"SELECT user_id AS grp, round({mean('v')} * COUNT(*) * (COUNT(v)"
    " * 1.0::DOUBLE / COUNT(*)) , 4) AS value FROM (SELECT *, CASE WHEN value <= 60 THEN value END AS v FROM events"
    " WHERE event_type = 'error') GROUP BY 1",
)
def null_share(spark, sf):
    # Sampling everything and counting exactly must give the true sum in spite of NULLs.
    cat = catalog(spark, sf)
    query = AggQuery("SUM", "value", "events", "user_id", (Predicate("event_type", "=", "error"),))
    holed = F.when(F.col("value") <= 60, F.col("value"))
    rows = sampled(cat, query, 1.0)["events"].withColumn("value", holed)
    answered = estimate.approx_sum(cat, query, {"events": rows}, group_counts(cat, query, "exact"), 1.0)
    return answered.select("grp", F.round("value", 4).alias("value"))


@check("approx_count", f"WITH {FLAG_COUNTS} SELECT grp, round(est_count, 6) AS value FROM counts")
def approx_count(spark, sf):
    answered = estimate.approx_count(group_counts(catalog(spark, sf), FLAGSHIP))
    return answered.select("grp", F.round("value", 6).alias("value"))


@check(
    "approx_count_sample",
    f"SELECT user_id AS grp, COUNT(*) / 0.1::DOUBLE AS value FROM events WHERE {FLAG_WHERE} AND {IN_SAMPLE} GROUP BY 1",
)
def approx_count_sample(spark, sf):
    _, sizes = predicted_and_sizes(catalog(spark, sf))
    return estimate.approx_count_sample(sizes, RATE)
