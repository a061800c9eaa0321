"""Whole runs and workload jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.common import (
    ESTIMATE, FLAG_COUNTS, FLAG_WHERE, FLAGSHIP, IN_SAMPLE, ITEM_COUNTS, ITEM_IN_SAMPLE, ITEM_KEY, ITEM_WHERE, ITEMS,
    STAR, STAR_COUNT, STAR_COUNT_FROM, TAIL, TAIL_COUNTS, TRUTH, bounds, catalog, check, folder, h, index_of, mean,
    total, u, weight,
)
from checks.repair import SUPPLY, supplied_ctes
from checks.scans import statement_lines
from checks.scoring import ALIGNED, RATIOS, TAIL_ALIGNED
from thingroups.plans import workloads
from thingroups.plans.staged import StagedRun, metric_frame
from thingroups.sources.workload import profile, profile_summary, read_workload
from thingroups.spec import AggQuery, Predicate, RunConfig

# Wall-clock seconds differ from run to run and are left out here.
def without_seconds(metrics):
    return metrics.drop(*[c for c in metrics.columns if c.endswith("_latency")])


def one_run(spark, sf, query, config=RunConfig(), table=None, synthetic_only=False):
    index = index_of(spark, sf, table) if table else None
    run = StagedRun(catalog(spark, sf), config, index=index)
    return without_seconds(metric_frame(spark, [{"idx": 0, **run.run(query, synthetic_only)}]))


def scored_sql(truth, estimate, name):
    """Error and precision / recall of one estimate, as a row."""
    aligned = ALIGNED.replace(f"({TRUTH})", f"({truth})").replace(f"({ESTIMATE})", f"({estimate})")
    return f"(WITH {aligned} SELECT round({RATIOS[name]}, 6) FROM aligned)"


def stages_sql(parts):
    return ", ".join(f"{value} AS {name}" for name, value in parts.items())


def rounded(row, columns):
    return row.select(*[F.round(c, 6).alias(c) if c.startswith(("re", "pre")) else F.col(c) for c in columns])


def topup_sql(table, where, key, in_sample, group, wanted):
    """CTEs: sample rows, rare groups, and the sample with its top-up rows."""
    return f"""smp AS (SELECT * FROM {table} WHERE {where} AND {in_sample}),
    rare AS (SELECT c.grp, {wanted} - coalesce(s.n, 0) AS need FROM counts c
      LEFT JOIN (SELECT {group} AS grp, COUNT(*) AS n FROM smp GROUP BY 1) s ON c.grp = s.grp WHERE coalesce(s.n, 0) < {wanted}),
    whole AS (SELECT * FROM smp UNION ALL SELECT * EXCLUDE (need, rn) FROM (
      SELECT t.*, need, row_number() OVER (PARTITION BY {group} ORDER BY {h('topup|42', key)}, {key}) AS rn
      FROM {table} t JOIN rare ON {group} = grp WHERE {where} AND NOT {in_sample}) WHERE rn <= need)"""


AVG_WHOLE = f"SELECT user_id AS grp, {mean('value')} AS value FROM whole GROUP BY 1"
AVG_STAGES = {
    "num_of_rare_groups": "(SELECT COUNT(*) FROM rare)",
    "re_with_samples": scored_sql(TRUTH, ESTIMATE, "relative_error"),
    "re_after_sampling_rare_groups": scored_sql(TRUTH, AVG_WHOLE, "relative_error"),
    "precision": scored_sql(TRUTH, AVG_WHOLE, "precision"),
    "recall": scored_sql(TRUTH, AVG_WHOLE, "recall"),
}


# What the supply stage adds to groups does not change which groups there are,
# so precision and recall of the last stage are those after the top-up.
@check(
    "staged_avg",
    f"WITH {FLAG_COUNTS}, {topup_sql('events', FLAG_WHERE, 'event_id', IN_SAMPLE, 'user_id', 5)} SELECT {stages_sql(AVG_STAGES)}",
)
def staged_avg(spark, sf):
    return rounded(one_run(spark, sf, FLAGSHIP, RunConfig(topup_rows=5), "events"), list(AVG_STAGES))


# With more rows wanted than there are, all candidates are drawn, whatever the order of the draws.
@check(
    "staged_avg_from_index",
    f"WITH {FLAG_COUNTS}, {topup_sql('events', FLAG_WHERE, 'event_id', IN_SAMPLE, 'user_id', 1_000_000)} SELECT {stages_sql(AVG_STAGES)}",
)
def staged_avg_from_index(spark, sf):
    config = RunConfig(topup_rows=1_000_000, topup_source="index")
    return rounded(one_run(spark, sf, FLAGSHIP, config, "events"), list(AVG_STAGES))


ITEM_TRUTH = f"SELECT l_partkey AS grp, {total('l_extendedprice')} AS value FROM lineitem WHERE {ITEM_WHERE} GROUP BY 1"
SUM_WHOLE = (
    f"SELECT w.grp, w.v * est_count AS value FROM (SELECT l_partkey AS grp, {mean('l_extendedprice')} AS v FROM whole"
    " GROUP BY 1) w JOIN counts ON w.grp = counts.grp"
)
SUM_STAGES = {
    "num_of_rare_groups": "(SELECT COUNT(*) FROM rare)",
    "re_after_sampling_rare_groups": scored_sql(ITEM_TRUTH, SUM_WHOLE, "relative_error"),
    "precision": scored_sql(ITEM_TRUTH, SUM_WHOLE, "precision"),
    "recall": scored_sql(ITEM_TRUTH, SUM_WHOLE, "recall"),
}


@check(
    "staged_sum",
    f"WITH {ITEM_COUNTS}, {topup_sql('lineitem', ITEM_WHERE, ITEM_KEY, ITEM_IN_SAMPLE, 'l_partkey', 5)}"
    f" SELECT {stages_sql(SUM_STAGES)}",
)
def staged_sum(spark, sf):
    return rounded(one_run(spark, sf, ITEMS, RunConfig(topup_rows=5)), list(SUM_STAGES))


DRAWN = f"20.0::DOUBLE + {u('condition|42', chr(39) + 'value' + chr(39) + ', grp, i')} * (hi - 20.0::DOUBLE)"


def generated_sql(groups):
    """Ten rows for each of the groups, errors above 20."""
    return (
        f"SELECT grp AS user_id, {DRAWN} AS value FROM ({groups}), range(1, 11) r(i),"
        " (SELECT max(value) AS hi FROM events)"
    )


MISSING = "SELECT grp FROM counts WHERE grp NOT IN (SELECT user_id FROM smp)"
GEN_WHOLE = (
    f"SELECT user_id AS grp, {mean('value')} AS value FROM (SELECT user_id, value FROM smp"
    f" UNION ALL {generated_sql(MISSING)}) WHERE value > 20 GROUP BY 1"
)
GEN_STAGES = {
    "num_of_missing_groups": f"(SELECT COUNT(*) FROM ({MISSING}))",
    "re_with_samples": scored_sql(TRUTH, ESTIMATE, "relative_error"),
    "re_after_supply_missing_groups": scored_sql(TRUTH, GEN_WHOLE, "relative_error"),
    "recall": scored_sql(TRUTH, GEN_WHOLE, "recall"),
}


@check(
    "staged_avg_generated",
    f"WITH {FLAG_COUNTS}, smp AS (SELECT * FROM events WHERE {FLAG_WHERE} AND {IN_SAMPLE}) SELECT {stages_sql(GEN_STAGES)}",
)
def staged_avg_generated(spark, sf):
    return rounded(one_run(spark, sf, FLAGSHIP, RunConfig(repair="generate"), "events"), list(GEN_STAGES))


@check("staged_avg_join")
def staged_avg_join(spark, sf):
    return one_run(spark, sf, STAR, RunConfig(topup_rows=5))


SUPPLY_WHERE = "event_type = 'error'"
SUPPLY_TRUTH = f"SELECT user_id AS grp, {mean('value')} AS value FROM events WHERE {SUPPLY_WHERE} GROUP BY 1"
SUPPLY_ESTIMATE = f"SELECT user_id AS grp, {mean('value')} AS value FROM events WHERE {SUPPLY_WHERE} AND {IN_SAMPLE} GROUP BY 1"
SUPPLY_LAST = (
    f"SELECT user_id AS grp, {mean('value')} AS value FROM (SELECT user_id, value FROM whole"
    " UNION ALL SELECT user_id, value FROM supplied) GROUP BY 1"
)
SUPPLY_STAGES = {
    "idx": "0",
    "re_with_samples": scored_sql(SUPPLY_TRUTH, SUPPLY_ESTIMATE, "relative_error"),
    "num_of_bitmap_ops": "NULL::BIGINT",
    "num_of_missing_groups": "NULL::BIGINT",
    "re_after_supply_missing_groups": "NULL::DOUBLE",
    "num_of_rare_groups": "(SELECT COUNT(*) FROM rare)",
    "re_after_sampling_rare_groups": scored_sql(SUPPLY_TRUTH, AVG_WHOLE, "relative_error"),
    "re_after_dynamic_supply": scored_sql(SUPPLY_TRUTH, SUPPLY_LAST, "relative_error"),
    "re": "NULL::DOUBLE",
    **{name: scored_sql(SUPPLY_TRUTH, SUPPLY_LAST, name) for name in ("precision", "recall", "missing_rate", "out_rate")},
}


# The whole metric row, but for the seconds: the last stage's supply by the recursive query.
@check(
    "staged_avg_supplied",
    f"WITH RECURSIVE counts AS (SELECT user_id AS grp, COUNT(*)::DOUBLE AS est_count FROM events WHERE {SUPPLY_WHERE} GROUP BY 1),"
    f" {topup_sql('events', SUPPLY_WHERE, 'event_id', IN_SAMPLE, 'user_id', 5)},"
    f" {supplied_ctes('SELECT user_id, value FROM whole')} SELECT {stages_sql(SUPPLY_STAGES)}",
)
def staged_avg_supplied(spark, sf):
    row = one_run(spark, sf, SUPPLY, RunConfig(topup_rows=5))
    return row.select(*[F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in row.dtypes])


@check(
    "staged_count",
    f"WITH {TAIL_COUNTS}, {TAIL_ALIGNED} SELECT round({RATIOS['relative_error']}, 6) AS re, "
    + ", ".join(f"round({RATIOS[r]}, 6) AS {r}" for r in ("precision", "recall", "missing_rate", "out_rate"))
    + " FROM aligned",
)
def staged_count(spark, sf):
    row = one_run(spark, sf, TAIL)
    return row.select(*[F.round(c, 6).alias(c) for c in ("re", "precision", "recall", "missing_rate", "out_rate")])


AT_END = AggQuery("COUNT", "l_quantity", "lineitem", "l_suppkey", (Predicate("l_quantity", ">=", 50),))


# Every group and every count is right at the end of the domain, whatever the bins say.
@check(
    "staged_count_at_max",
    "SELECT 0.0 AS re, 1.0 AS precision, (COUNT(*) > 0)::INT::DOUBLE AS recall, 0.0 AS missing_rate, 0.0 AS out_rate"
    " FROM lineitem WHERE l_quantity >= 50",
)
def staged_count_at_max(spark, sf):
    row = one_run(spark, sf, AT_END)
    return row.select(*[F.round(c, 6).alias(c) for c in ("re", "precision", "recall", "missing_rate", "out_rate")])


STAR_WHERE = "l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey = 3) AND l_discount >= 0.05"
STAR_COUNTS = (
    f"{bounds('lineitem', 'l_discount')}, counts AS (SELECT grp, est_count FROM (SELECT l_returnflag AS grp,"
    f" SUM({weight('l_discount', '>=', 0.05)}) AS est_count FROM lineitem, b"
    " WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey = 3) GROUP BY 1) WHERE est_count > 0)"
)
STAR_TRUTH = f"SELECT l_returnflag AS grp, {total('l_quantity')} AS value FROM lineitem WHERE {STAR_WHERE} GROUP BY 1"
STAR_WHOLE = (
    f"SELECT w.grp, w.v * est_count AS value FROM (SELECT l_returnflag AS grp, {mean('l_quantity')} AS v FROM whole"
    " GROUP BY 1) w JOIN counts ON w.grp = counts.grp"
)
STAR_STAGES = {
    "num_of_rare_groups": "(SELECT COUNT(*) FROM rare)",
    "re_after_sampling_rare_groups": scored_sql(STAR_TRUTH, STAR_WHOLE, "relative_error"),
    "precision": scored_sql(STAR_TRUTH, STAR_WHOLE, "precision"),
    "recall": scored_sql(STAR_TRUTH, STAR_WHOLE, "recall"),
}


# Thin groups are those of the filtered fact sample, before it meets the dimension.
STAR_TOPUP = topup_sql("lineitem", STAR_WHERE, ITEM_KEY, ITEM_IN_SAMPLE, "l_returnflag", 5).replace(
    "COUNT(*) AS n FROM smp", f"COUNT(*) AS n FROM lineitem WHERE l_discount >= 0.05 AND {ITEM_IN_SAMPLE}"
)


@check("staged_sum_join", f"WITH {STAR_COUNTS}, {STAR_TOPUP} SELECT {stages_sql(STAR_STAGES)}")
def staged_sum_join(spark, sf):
    return rounded(one_run(spark, sf, STAR.with_func("SUM"), RunConfig(topup_rows=5)), list(STAR_STAGES))


COUNT_TRUTH = f"SELECT l_suppkey AS grp, COUNT(l_quantity)::DOUBLE AS value FROM {STAR_COUNT_FROM} GROUP BY 1"
COUNT_ESTIMATE = (
    f"SELECT * FROM (SELECT l_suppkey AS grp, SUM({weight('l_extendedprice', '<', 20000)}) AS value FROM lineitem, b"
    " WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY 1) WHERE value > 0"
)
COUNT_STAGES = {
    "re": scored_sql(COUNT_TRUTH, COUNT_ESTIMATE, "relative_error"),
    "precision": scored_sql(COUNT_TRUTH, COUNT_ESTIMATE, "precision"),
    "recall": scored_sql(COUNT_TRUTH, COUNT_ESTIMATE, "recall"),
}


@check("staged_count_join", f"WITH {bounds('lineitem', 'l_extendedprice')} SELECT {stages_sql(COUNT_STAGES)}")
def staged_count_join(spark, sf):
    return rounded(one_run(spark, sf, STAR_COUNT, table="lineitem"), list(COUNT_STAGES))


SYNTHETIC = (
    f"SELECT user_id AS grp, {mean('value')} AS value FROM"
    f" ({generated_sql('SELECT DISTINCT user_id AS grp FROM events')}) WHERE value > 20 GROUP BY 1"
)
SYNTHETIC_STAGES = {
    "re_after_supply_missing_groups": scored_sql(TRUTH, SYNTHETIC, "relative_error"),
    "precision": scored_sql(TRUTH, SYNTHETIC, "precision"),
    "recall": scored_sql(TRUTH, SYNTHETIC, "recall"),
}


@check("staged_avg_synthetic", f"SELECT {stages_sql(SYNTHETIC_STAGES)}")
def staged_avg_synthetic(spark, sf):
    return rounded(one_run(spark, sf, FLAGSHIP, synthetic_only=True), list(SYNTHETIC_STAGES))


@check("metric_row")
def metric_row(spark, sf):
    run = StagedRun(catalog(spark, sf), RunConfig(topup_rows=3))
    return metric_frame(spark, [{"idx": 0, **run.run(FLAGSHIP)}])


# --- workloads ------------------------------------------------------------------------


def type_lines(spark, sf):
    """Statements of one to three predicates per event type, and one that cannot run."""
    types = catalog(spark, sf).frame("events").select("event_type").distinct()
    head = F.lit("SELECT user_id, COUNT(value) FROM events WHERE event_type = '")
    tails = ["", " AND value > 20", " AND value > 20 AND user_id < 90"]
    lines = [F.concat(head, F.col("event_type"), F.lit(f"'{tail} GROUP BY user_id;")) for tail in tails]
    broken = F.concat(F.lit("SELECT user_id, COUNT(value) FROM events WHERE event_type = '"), "event_type", F.lit("' OR value > 3 GROUP BY user_id;"))
    return types.orderBy("event_type").select(F.explode(F.array(*lines, broken)).alias("value"))


def type_workload(spark, sf, name):
    path = folder(spark, sf, f"workload_{name}")
    type_lines(spark, sf).write.mode("overwrite").text(path)
    return read_workload(spark, path, name)


def type_run(spark, sf, name):
    statements = type_workload(spark, sf, name).persist()
    run = StagedRun(catalog(spark, sf))
    return run, statements, workloads.run_workload(run, statements, parallel=4)


@check(
    "workload_profile",
    "SELECT 'SUM' AS func, 'event_type' AS grp_column, 1 AS n_predicates, COUNT(DISTINCT user_id) AS n_statements FROM events"
    " UNION ALL SELECT 'COUNT', 'user_id', p, COUNT(DISTINCT event_type) FROM events, range(1, 4) r(p) GROUP BY p",
)
def workload_profile(spark, sf):
    path = folder(spark, sf, "workload_profile_users")
    statement_lines(spark, sf).write.mode("overwrite").text(path)
    both = read_workload(spark, path, "users").unionByName(type_workload(spark, sf, "profile"))
    return profile_summary(profile(both))


def workload_errors_sql():
    """CTE ``errors``: selectivity and mean count error of every statement that runs."""
    tails = {1: ("TRUE", "1.0::DOUBLE"), 2: ("value > 20", weight("value", ">", 20)),
             3: ("value > 20 AND user_id < 90", f"{weight('value', '>', 20)} * (user_id < 90)::INT")}
    parts = " UNION ALL ".join(
        f"SELECT event_type, {n} AS n_predicates, user_id, SUM(({raw})::INT)::DOUBLE AS t, SUM({est}) AS e FROM events, b GROUP BY 1, 3"
        for n, (raw, est) in tails.items()
    )
    return (
        f"WITH {bounds('events', 'value')}, per_group AS ({parts}), errors AS (SELECT event_type, n_predicates,"
        " SUM(t) / (SELECT COUNT(*) FROM events) AS selectivity, avg(CASE WHEN t = 0 OR e = 0 THEN 1.0::DOUBLE"
        " ELSE least(1.0::DOUBLE, abs(t - e) / (t + 1e-8::DOUBLE)) END) AS err FROM per_group WHERE t > 0 OR e > 0 GROUP BY 1, 2)"
    )


@check(
    "workload_run",
    workload_errors_sql() + " SELECT event_type, n_predicates, round(err, 6) AS re, FALSE AS failed FROM errors"
    " UNION ALL SELECT DISTINCT event_type, 0, NULL, TRUE FROM events",
)
def workload_run(spark, sf):
    _, _, metrics = type_run(spark, sf, "run")
    kind = F.regexp_extract("sql", "event_type = '([^']*)'", 1)
    failed = F.col("error").isNotNull().alias("failed")
    return metrics.select(kind.alias("event_type"), "n_predicates", F.round("re", 6).alias("re"), failed)


def truths_sql():
    """Exact answers of the statements of the type workload, one table."""
    tails = {1: "TRUE", 2: "value > 20", 3: "value > 20 AND user_id < 90"}
    return " UNION ALL ".join(
        f"SELECT event_type, {n} AS n_predicates, CAST(user_id AS VARCHAR) AS grp, COUNT(value)::DOUBLE AS value FROM events"
        f" WHERE {tail} GROUP BY 1, 3"
        for n, tail in tails.items()
    )


@check("workload_shared_truths", truths_sql())
def shared_truths(spark, sf):
    run, statements = StagedRun(catalog(spark, sf)), type_workload(spark, sf, "shared")
    lines = [(line, idx, query) for idx, line, query in workloads.numbered(workloads.queries_of(run, statements))]
    found = workloads.shared_truths(run.catalog, [(line["workload"], idx, q) for line, idx, q in lines if not isinstance(q, Exception)])
    kinds = spark.createDataFrame(
        [(idx, line["n_predicates"], q.predicates[0].value) for line, idx, q in lines if not isinstance(q, Exception)],
        "idx int, n_predicates int, event_type string",
    )
    return found.join(kinds, "idx").select("event_type", "n_predicates", "grp", "value")


@check(
    "workload_by_predicate_count",
    workload_errors_sql() + " SELECT n_predicates, COUNT(*) AS n_statements, round(avg(err), 6) AS mean_error FROM errors GROUP BY 1",
)
def by_predicate_count(spark, sf):
    _, _, metrics = type_run(spark, sf, "by_count")
    return workloads.by_predicate_count(metrics).withColumn("mean_error", F.round("mean_error", 6))


@check(
    "workload_by_selectivity",
    workload_errors_sql() + " SELECT selectivity_class, COUNT(*) AS n_statements, round(avg(selectivity), 6) AS mean_selectivity,"
    " round(avg(err), 6) AS mean_error FROM (SELECT *, ntile(4) OVER (ORDER BY selectivity DESC, event_type, n_predicates)"
    " AS selectivity_class FROM errors) GROUP BY 1",
)
def by_selectivity(spark, sf):
    run, statements, metrics = type_run(spark, sf, "by_selectivity")
    found = workloads.by_selectivity(metrics, workloads.selectivities(run, statements))
    return found.withColumns({c: F.round(c, 6) for c in ("mean_selectivity", "mean_error")})
