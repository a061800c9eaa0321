"""Sources, sinks, filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.common import FLAG_WHERE, FLAGSHIP, STAR, catalog, check, folder, index_of, keep, mean
from thingroups.operators.filters import drop_incomplete, route, where_all
from thingroups.operators.generate import fit, load_or_fit, save_fit
from thingroups.operators.relational import exact, filtered_frames, full_frames, matching_rows
from thingroups.sources.catalog import (
    fetch_by_locator, scan, scan_bernoulli, scan_stored, scan_with_locator,
)
from thingroups.sources.storage import read_truth, write_metrics_csv, write_truth
from thingroups.sources.workload import read_workload
from thingroups.spec import Predicate

ITEM_COLUMNS = (
    "l_partkey, l_suppkey, l_linenumber, l_returnflag, l_linestatus, l_quantity, l_extendedprice,"
    " l_discount, l_tax"
)


def micros(rows):
    """Timestamps as whole microseconds, which print alike everywhere."""
    stamps = [c for c, kind in rows.dtypes if kind.startswith("timestamp")]
    return rows.withColumns({c: F.unix_micros(F.col(c).cast("timestamp")) for c in stamps})


@check("scan_project", f"SELECT {ITEM_COLUMNS} FROM lineitem")
def scan_project(spark, sf):
    return scan(catalog(spark, sf), "lineitem")


@check(
    "scan_bernoulli",
    f"SELECT event_id, user_id, event_type, value FROM events WHERE {keep(0.2, 'index|42', 'event_id')}",
)
def bernoulli(spark, sf):
    return scan_bernoulli(catalog(spark, sf), "events", 0.2)


@check(
    "scan_with_locator",
    "SELECT event_id, epoch_us(ts) AS ts, user_id, event_type, value, props, CAST(event_id AS VARCHAR) AS locator FROM events",
)
def with_locator(spark, sf):
    return micros(scan_with_locator(catalog(spark, sf), "events"))


@check(
    "fetch_by_locator",
    "SELECT CAST(event_id AS VARCHAR) AS locator, event_id, epoch_us(ts) AS ts, user_id, event_type, value, props"
    " FROM events WHERE value > 150",
)
def by_locator(spark, sf):
    rows = scan_with_locator(catalog(spark, sf), "events")
    return micros(fetch_by_locator(rows, rows.where("value > 150").select("locator")))


def statement_lines(spark, sf):
    """One statement per user, as a user would write them into a file."""
    users = catalog(spark, sf).frame("events").select("user_id").distinct()
    text = F.format_string("  SELECT event_type, SUM(value) FROM events WHERE user_id = %d GROUP BY event_type; ", "user_id")
    # An empty line after every statement.
    return users.select(F.explode(F.array(text, F.lit(""))).alias("value"))


@check(
    "workload_source",
    "SELECT 'users' AS workload, 'SELECT event_type, SUM(value) FROM events WHERE user_id = ' || user_id"
    " || ' GROUP BY event_type' AS sql FROM (SELECT DISTINCT user_id FROM events)",
)
def workload_source(spark, sf):
    path = folder(spark, sf, "workload_users")
    statement_lines(spark, sf).write.mode("overwrite").text(path)
    return read_workload(spark, path, "users").select("workload", "sql")


@check(
    "rowid_index_write",
    "SELECT COUNT(*) AS n_rows, COUNT(*) AS n_ids, COUNT(DISTINCT user_id) AS n_users FROM events",
)
def rowid_index_write(spark, sf):
    rows = index_of(spark, sf, "events").write_rows()
    return rows.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("rid").alias("n_ids"),
        F.count_distinct("user_id").alias("n_users"),
    )


TRUTH_SQL = f"SELECT user_id AS grp, {mean('value')} AS value FROM events WHERE {FLAG_WHERE} GROUP BY 1"


@check("ground_truth_write", f"SELECT CAST(grp AS VARCHAR) AS grp, value, 0 AS idx FROM ({TRUTH_SQL})")
def ground_truth_write(spark, sf):
    place = folder(spark, sf, "truth_w")
    write_truth(exact(catalog(spark, sf), FLAGSHIP), place, "test", "avg", 0)
    stored = spark.read.option("basePath", f"{place}/truth").schema(
        "grp string, value double, dataset string, workload string, idx int"
    ).parquet(f"{place}/truth")
    return stored.where("workload = 'avg'").select("grp", "value", "idx")


@check("ground_truth_read", TRUTH_SQL)
def ground_truth_read(spark, sf):
    place = folder(spark, sf, "truth_r")
    cat = catalog(spark, sf)
    write_truth(exact(cat, FLAGSHIP), place, "test", "avg", 0)
    write_truth(exact(cat, STAR), place, "test", "avg", 1)
    return read_truth(spark, place, "test", "avg", 0, "bigint")


@check(
    "metrics_csv_sink",
    f"SELECT event_type AS idx, format('{{:.4f}}', {mean('value')}) AS re,"
    " CAST(NULL AS VARCHAR) AS recall FROM events GROUP BY event_type",
)
def metrics_csv_sink(spark, sf):
    path = folder(spark, sf, "metrics_csv")
    cat = catalog(spark, sf)
    # one line per event type stands for one per statement
    average = exact(cat, FLAGSHIP.__class__("AVG", "value", "events", "event_type"))
    metrics = average.select(F.col("grp").alias("idx"), F.col("value").alias("re"), F.lit(1.0).alias("ignored"))
    write_metrics_csv(metrics, path, ["idx", "re", "recall"])
    return spark.read.option("header", True).schema("idx string, re string, recall string").csv(path)


MODEL_SQL = f"""
SELECT grp, fit_rows, value, event_type FROM
 (SELECT user_id AS grp, COUNT(*) AS fit_rows, {mean('value')} AS value FROM events GROUP BY 1)
 JOIN (SELECT user_id AS grp, event_type, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS rn
       FROM (SELECT user_id, event_type, COUNT(*) AS n FROM events GROUP BY 1, 2)) USING (grp)
WHERE rn = 1
"""


@check("model_write", MODEL_SQL)
def model_write(spark, sf):
    cat = catalog(spark, sf)
    fitted = fit(scan_stored(cat, "events"), cat.spec("events"), "user_id")
    return save_fit(fitted, folder(spark, sf, "model_w")).by_group


@check("model_read", MODEL_SQL)
def model_read(spark, sf):
    cat, place = catalog(spark, sf), folder(spark, sf, "model_r")
    for _ in range(2):  # the second call finds the model of the first
        fitted = load_or_fit(scan_stored(cat, "events"), cat.spec("events"), "user_id", place)
    return fitted.by_group


# --- filters ----------------------------------------------------------------------

EVENT_ROWS = "SELECT event_id, user_id, event_type, value FROM events WHERE "


def _filter(name, predicates, where):
    @check(name, EVENT_ROWS + where)
    def run(spark, sf):
        cat = catalog(spark, sf)
        return where_all(scan_stored(cat, "events"), predicates, cat.spec("events"))


_filter("filter_eq", [Predicate("event_type", "=", "click")], "event_type = 'click'")
_filter("filter_gt", [Predicate("value", ">", "49.99")], "value > 49.99")
_filter("filter_gte", [Predicate("value", ">=", 50)], "value >= 50")
_filter("filter_lt", [Predicate("value", "<", 3.5)], "value < 3.5")
_filter("filter_lte", [Predicate("value", "<=", 3.5)], "value <= 3.5")
_filter("filter_int_fraction", [Predicate("user_id", "<", 3.5)], "user_id < 3.5")
_filter("filter_int_fraction_text", [Predicate("user_id", ">=", "3.5")], "user_id >= 3.5")
_filter("filter_int_equal_fraction", [Predicate("user_id", "=", 3.5)], "user_id = 3.5")
_filter(
    "filter_conjunction",
    [
        Predicate("event_type", "=", "error"),
        Predicate("value", ">", 20),
        Predicate("value", "<=", 200),
        Predicate("user_id", ">=", 5),
        Predicate("user_id", "<", 120),
    ],
    "event_type = 'error' AND value > 20 AND value <= 200 AND user_id >= 5 AND user_id < 120",
)


@check(
    "filter_routing",
    "SELECT 'lineitem' AS tbl, l_suppkey AS k, COUNT(*) AS n FROM lineitem WHERE l_discount >= 0.05 GROUP BY 2"
    " UNION ALL SELECT 'supplier', s_suppkey, 1 FROM supplier WHERE s_nationkey = 3",
)
def filter_routing(spark, sf):
    cat = catalog(spark, sf)
    assert set(route(STAR.predicates, cat.specs, cat.tables_of(STAR))) == {"lineitem", "supplier"}
    parts = filtered_frames(cat, STAR, full_frames(cat, STAR))
    fact = parts["lineitem"].groupBy(F.col("l_suppkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    dim = parts["supplier"].select(F.lit("supplier").alias("tbl"), F.col("s_suppkey").alias("k"), F.lit(1).cast("bigint").alias("n"))
    return fact.select(F.lit("lineitem").alias("tbl"), "k", "n").unionByName(dim)


@check(
    "drop_incomplete",
    "SELECT event_id, user_id, event_type, value FROM events WHERE event_type <> 'view' AND value <> 1.5",
)
def incomplete(spark, sf):
    cat = catalog(spark, sf)
    holed = scan_stored(cat, "events").withColumns(
        {"event_type": F.nullif("event_type", F.lit("view")), "value": F.nullif("value", F.lit(1.5))}
    )
    return drop_incomplete(holed, cat.spec("events").columns)


@check("project_group_agg", f"SELECT user_id AS grp, {mean('value')} AS value FROM events GROUP BY 1")
def project_group_agg(spark, sf):
    return exact(catalog(spark, sf), FLAGSHIP.__class__("AVG", "value", "events", "user_id"))


@check(
    "matching_rows",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, epoch_us(l_shipdate) AS l_shipdate, l_returnflag,"
    " l_linestatus, l_quantity, l_discount, l_tax, s_suppkey, s_nationkey, s_acctbal FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey = 3 AND l_discount >= 0.05",
)
def matching(spark, sf):
    return micros(matching_rows(catalog(spark, sf), STAR))
