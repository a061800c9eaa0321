"""Scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.common import (
    ESTIMATE, TAIL_COUNTS, TAIL_TRUTH, TRUTH, catalog, check, truth_and_sample, truth_and_tail,
)
from thingroups.operators import score as scores

ALIGNED = f"""aligned AS (SELECT coalesce(t.grp, e.grp) AS grp, t.value AS truth, e.value AS estimate,
  CASE WHEN t.grp IS NULL OR e.grp IS NULL THEN 1.0::DOUBLE
   ELSE least(1.0::DOUBLE, abs(t.value - e.value) / (abs(t.value) + 1e-8::DOUBLE)) END AS error,
  t.grp IS NOT NULL AND e.grp IS NOT NULL AS tp, t.grp IS NULL AS fp, e.grp IS NULL AS fn
  FROM ({TRUTH}) t FULL OUTER JOIN ({ESTIMATE}) e ON t.grp = e.grp)"""
TAIL_ALIGNED = (
    ALIGNED.replace(f"({TRUTH})", f"({TAIL_TRUTH})").replace(f"({ESTIMATE})", "(SELECT grp, est_count AS value FROM counts)")
)
RATIOS = {
    "relative_error": "avg(error)",
    "precision": "SUM(tp::INT)::DOUBLE / (SUM(tp::INT) + SUM(fp::INT))",
    "recall": "SUM(tp::INT)::DOUBLE / (SUM(tp::INT) + SUM(fn::INT))",
    "missing_rate": "SUM(fn::INT)::DOUBLE / (SUM(tp::INT) + SUM(fn::INT))",
    "out_rate": "SUM(fp::INT)::DOUBLE / (SUM(tp::INT) + SUM(fn::INT))",
}


def _one(name, ratio):
    @check(
        name,
        f"WITH {ALIGNED}, {TAIL_COUNTS}, tail AS (SELECT * FROM ({'WITH ' + TAIL_ALIGNED + ' SELECT * FROM aligned'}))"
        f" SELECT 'sample' AS what, round({ratio}, 6) AS {name} FROM aligned"
        f" UNION ALL SELECT 'index', round({ratio}, 6) FROM tail",
    )
    def run(spark, sf):
        cat = catalog(spark, sf)
        parts = []
        for what, pair in (("sample", truth_and_sample(cat)), ("index", truth_and_tail(cat))):
            parts.append(scores.score(*pair).select(F.lit(what).alias("what"), F.round(name, 6).alias(name)))
        return parts[0].unionByName(parts[1])


for _name, _ratio in RATIOS.items():
    _one(_name, _ratio)


@check(
    "relative_error_per_group",
    f"WITH {ALIGNED} SELECT grp, truth, estimate, round(error, 9) AS error FROM aligned",
)
def per_group(spark, sf):
    errors = scores.group_errors(*truth_and_sample(catalog(spark, sf)))
    return errors.withColumn("error", F.round("error", 9))


@check(
    "true_negatives",
    f"SELECT DISTINCT user_id AS grp FROM events WHERE user_id NOT IN (SELECT grp FROM ({TAIL_TRUTH}))"
    f" AND user_id NOT IN (WITH {TAIL_COUNTS} SELECT grp FROM counts)",
)
def true_negatives(spark, sf):
    cat = catalog(spark, sf)
    domain = cat.frame("events").select(F.col("user_id").alias("grp")).distinct()
    return scores.true_negatives(domain, *truth_and_tail(cat))


@check(
    "empty_estimate_rule",
    "SELECT 1.0::DOUBLE AS relative_error, 1.0::DOUBLE AS precision, 0.0::DOUBLE AS recall, 1.0::DOUBLE AS missing_rate,"
    f" 0.0::DOUBLE AS out_rate, 0 AS tp, 0 AS fp, COUNT(*) AS fn FROM ({TRUTH})",
)
def empty_estimate(spark, sf):
    truth, estimate = truth_and_sample(catalog(spark, sf))
    return scores.score(truth, estimate.where(F.lit(False)))
