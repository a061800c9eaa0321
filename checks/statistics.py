"""Catalog statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.common import catalog, check, folder, mean, weight
from thingroups.operators import stats
from thingroups.operators.groups import bitmap_group_counts, group_counts
from thingroups.sources.catalog import Catalog, scan
from thingroups.sources.domain import StoredDomains
from thingroups.sources.storage import BitmapIndex
from thingroups.spec import AggQuery, Predicate, TableSpec

CATEGORICAL = ["l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus"]
NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def each(columns, line):
    return " UNION ALL ".join(line.format(c=c) for c in columns)


def items(spark, sf):
    cat = catalog(spark, sf)
    return scan(cat, "lineitem"), cat.spec("lineitem")


@check(
    "domain_distinct",
    each(CATEGORICAL, "SELECT DISTINCT '{c}' AS col, CAST({c} AS VARCHAR) AS value FROM lineitem"),
)
def domain_distinct(spark, sf):
    df, spec = items(spark, sf)
    return stats.domain_values(df, spec.categorical).withColumnRenamed("column", "col")


@check("domain_minmax", each(NUMERIC, "SELECT '{c}' AS col, min({c}) AS lo, max({c}) AS hi FROM lineitem"))
def domain_minmax(spark, sf):
    df, spec = items(spark, sf)
    return stats.numeric_bounds(df, spec.numeric).withColumnRenamed("column", "col")


@check(
    "domain_cardinality", each(CATEGORICAL, "SELECT '{c}' AS col, COUNT(DISTINCT {c}) AS n_values FROM lineitem")
)
def domain_cardinality(spark, sf):
    df, spec = items(spark, sf)
    return stats.cardinality(df, spec.categorical).withColumnRenamed("column", "col")


@check(
    "value_counts",
    each(CATEGORICAL, "SELECT '{c}' AS col, CAST({c} AS VARCHAR) AS value, COUNT(*) AS n FROM lineitem GROUP BY 2"),
)
def value_counts(spark, sf):
    df, spec = items(spark, sf)
    return stats.value_counts(df, spec.categorical).withColumnRenamed("column", "col")


@check(
    "norm_stats",
    " UNION ALL ".join(
        [f"SELECT '{c}' AS col, {mean(c)} AS mean, round(stddev_samp({c}), 6) AS std FROM lineitem" for c in NUMERIC]
        + [f"SELECT '{c}', 0.0, 1.0" for c in CATEGORICAL]
    ),
)
def norm_stats(spark, sf):
    df, spec = items(spark, sf)
    out = stats.norm_stats(df, spec).withColumnRenamed("column", "col")
    return out.withColumn("std", F.round("std", 6))


@check("lookup_unique", "SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS value FROM lineitem")
def lookup_unique(spark, sf):
    df, spec = items(spark, sf)
    return stats.lookup_unique(stats.domain_values(df, spec.categorical), "l_suppkey")


@check("lookup_minmax", "SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem")
def lookup_minmax(spark, sf):
    df, spec = items(spark, sf)
    return stats.lookup_minmax(stats.numeric_bounds(df, spec.numeric), "l_extendedprice")


# --- stored statistics, dates and times ---------------------------------------------------


@check(
    "stored_domains",
    " UNION ALL ".join(
        f"SELECT '{c}' AS col, COUNT({c}) AS n, COUNT(*) - COUNT({c}) AS n_null, min({c})::DOUBLE AS lo, max({c})::DOUBLE AS hi,"
        f" round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std FROM lineitem"
        for c in NUMERIC
    )
    + " UNION ALL SELECT 'l_returnflag', COUNT(l_returnflag), COUNT(*) - COUNT(l_returnflag), NULL, NULL, NULL, NULL FROM lineitem",
)
def stored_domains(spark, sf):
    domains = StoredDomains(catalog(spark, sf), "lineitem", folder(spark, sf, "domains"))
    domains.refresh()
    found = domains.merged().where(F.col("column").isin(*NUMERIC, "l_returnflag"))
    return found.select(F.col("column").alias("col"), "n", "n_null", "lo", "hi", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


TIMED = {"events": TableSpec("events", {"user_id": "int", "event_type": "str", "ts": "num"}, ("event_id",), True)}


def timed(spark, sf):
    """Events with their time as a numeric column."""
    return Catalog.from_files(spark, TIMED, sf, name=f"timed_{catalog(spark, sf).name}")


def middle(spark, sf):
    """A literal inside the table's span of time, as text."""
    span = catalog(spark, sf).frame("events").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    at = F.timestamp_seconds(F.floor((F.unix_micros(F.col("lo").cast("timestamp")) * 0.6 + F.unix_micros(F.col("hi").cast("timestamp")) * 0.4) / 1e6))
    return span.select(F.date_format(at, "yyyy-MM-dd HH:mm:ss")).first()[0]


SECONDS = "(epoch_us(ts) / 1000000.0::DOUBLE)"
TIMES = (
    f"times AS (SELECT *, {SECONDS} AS s FROM events), b AS (SELECT lo, hi, (hi - lo) / 100 AS w, mid FROM (SELECT min(s) AS lo, max(s) AS hi,"
    " floor((min(epoch_us(ts))::DOUBLE * 0.6 + max(epoch_us(ts))::DOUBLE * 0.4) / 1000000.0::DOUBLE) AS mid FROM times))"
)


def times_sql():
    part = weight("s", ">", "b.mid").replace("b.mid::DOUBLE", "b.mid")
    return (
        f"WITH {TIMES} SELECT grp, round(est_count, 4) AS est_count FROM (SELECT user_id AS grp, SUM({part}) AS est_count"
        " FROM times, b WHERE event_type = 'error' GROUP BY 1) WHERE est_count > 0"
    )


def timed_query(spark, sf):
    return AggQuery("COUNT", "ts", "events", "user_id", (Predicate("event_type", "=", "error"), Predicate("ts", ">", middle(spark, sf))))


@check("group_counts_timestamp", times_sql())
def counts_of_times(spark, sf):
    counts = group_counts(timed(spark, sf), timed_query(spark, sf))
    return counts.select("grp", F.round("est_count", 4).alias("est_count"))


@check("group_counts_timestamp_bitmap", times_sql())
def counts_of_times_from_index(spark, sf):
    cat = timed(spark, sf)
    index = BitmapIndex(cat, "events", folder(spark, sf, "timed"))
    index.write()
    counts = bitmap_group_counts(cat, timed_query(spark, sf), index)
    return counts.select("grp", F.round("est_count", 4).alias("est_count"))
