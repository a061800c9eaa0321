"""Stored statistics: merged over files, refreshed by new ones, read in place of the table."""

import datetime

import pytest
from pyspark.sql import functions as F

from thingroups import AggQuery, Catalog, Predicate, TableSpec
from thingroups.functions.numbers import number_of
from thingroups.operators import generate, groups, stats
from thingroups.sources.domain import StoredDomains

SPEC = TableSpec("t", {"g": "int", "c": "str", "x": "num", "day": "num", "at": "num"}, ("id",), True)


def part(spark, a, b):
    i = F.col("id")
    return spark.range(a, b).select(
        "id",
        (i % 5_000).alias("g"),
        F.concat(F.lit("c"), (i % 700).cast("string")).alias("c"),
        F.when(i % 9 != 0, (i * 37 % 10_007).cast("double")).alias("x"),
        F.date_add(F.lit(datetime.date(2020, 1, 1)), (i % 400).cast("int")).alias("day"),
        F.timestamp_micros(i * 1_234_567 + 1_500_000_000_000_000).alias("at"),
    )


def opened(spark, folder):
    return Catalog.from_files(spark, {"t": SPEC}, folder, name="domains")


def test_new_files_are_read_once_and_lost_ones_drop_out(spark, tmp_path):
    folder = f"{tmp_path}/t.parquet"
    part(spark, 0, 20_000).repartition(3).write.parquet(folder)
    cat = opened(spark, str(tmp_path))
    domains = StoredDomains(cat, "t", str(tmp_path))
    assert domains.refresh() == 3 and domains.refresh() == 0
    part(spark, 20_000, 30_000).coalesce(1).write.mode("append").parquet(folder)
    cat = opened(spark, str(tmp_path))
    domains = StoredDomains(cat, "t", str(tmp_path))
    assert domains.refresh() == 1
    whole = cat.frame("t")
    rows = {r["column"]: r for r in domains.merged().collect()}
    bounds = {r["column"]: (r["lo"], r["hi"]) for r in stats.numeric_bounds(whole, ["g", "x", "day", "at"]).collect()}
    assert domains.bounds() == bounds
    exact = {r["column"]: r["n_values"] for r in stats.cardinality(whole, list(SPEC.columns)).collect()}
    for column, r in rows.items():
        assert r["n"] + r["n_null"] == 30_000
        assert abs(r["n_values"] - exact[column]) <= 0.03 * exact[column], column
    x = whole.agg(F.avg("x"), F.stddev_samp("x"), F.count("x")).first()
    assert (rows["x"]["mean"], rows["x"]["std"], rows["x"]["n"]) == pytest.approx(tuple(x), rel=1e-9)
    asked = [0.1, 0.5, 0.9]
    for found, rank in zip(domains.quantiles("x", asked), asked, strict=True):
        assert whole.where(F.col("x") <= found).count() / x[2] == pytest.approx(rank, abs=0.02)
    # without the files' rows: only what is stored is read
    closed = opened(spark, str(tmp_path))
    stored = StoredDomains(closed, "t", str(tmp_path))
    closed.domains["t"] = stored
    stored.refresh()
    plan = stored.merged()._jdf.queryExecution().executedPlan().toString()
    assert "t.parquet" not in plan
    assert closed.bounds("t") == bounds


def test_predicates_on_dates_and_times(spark, tmp_path):
    part(spark, 0, 5_000).write.parquet(f"{tmp_path}/t.parquet")
    cat = opened(spark, str(tmp_path))
    for column, value in (("day", "2020-06-15"), ("at", "2017-07-14 02:45:00")):
        query = AggQuery("COUNT", "x", "t", "c", (Predicate(column, ">=", value),))
        truth = cat.frame("t").where(F.col(column) >= F.lit(value).cast(cat.frame("t").schema[column].dataType)).count()
        exact = groups.group_counts(cat, query, "exact").agg(F.sum("est_count")).first()[0]
        guessed = groups.group_counts(cat, query).agg(F.sum("est_count")).first()[0]
        assert exact == truth and abs(guessed - truth) <= 0.02 * 5_000
        types = {f.name: f.dataType for f in cat.frame("t").schema.fields}
        wanted = spark.createDataFrame([("c1",)], "grp string")
        made = generate.condition_rows(wanted, query.predicates, "c", SPEC, types, cat.bounds("t"), 50)
        lo, hi = number_of(value, types[column]), cat.bounds("t")[column][1]
        drawn = [number_of(r[column], types[column]) for r in made.collect()]
        assert len(drawn) == 50 and all(lo - 1 <= x <= hi for x in drawn) and len(set(drawn)) > 10
