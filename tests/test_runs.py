import random

import pytest
from pyspark.sql import functions as F

from checks.common import FLAGSHIP, STAR, catalog
from conftest import DATA
from thingroups import AggQuery, Catalog, JoinSpec, Predicate, RunConfig
from thingroups.operators import estimate, filters, relational, sampling
from thingroups.operators.partial_fit import StoredModel
from thingroups.operators.relational import exact
from thingroups.operators.score import score
from thingroups.plans import workloads
from thingroups.plans.staged import StagedRun, metric_frame
from thingroups.sources import datasets
from thingroups.sources.catalog import fetch_by_locator, scan_bernoulli, scan_with_locator
from thingroups.sources.storage import cut, formatted, read_truth, scratch_folder
from thingroups.sources.workload import profile, read_workload, to_query


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_full_sample_has_no_error(spark):
    cat = catalog(spark, DATA)
    for query in (FLAGSHIP, STAR):
        frames = sampling.sample_frames(cat, cat.tables_of(query), 1.0)
        assert score(relational.exact(cat, query), estimate.approx_avg(cat, query, frames)).first()["relative_error"] == 0


def test_topup_never_lowers_recall_and_fills_groups(spark):
    cat = catalog(spark, DATA)
    last = 0.0
    for k in (1, 5):
        metrics = StagedRun(cat, RunConfig(topup_rows=k)).run(FLAGSHIP)
        assert metrics["recall"] >= last and metrics["recall"] == 1.0
        assert metrics["re_with_samples"] == pytest.approx(0.6060, abs=1e-4)
        assert metrics["re_after_sampling_rare_groups"] <= metrics["re_with_samples"]
        last = metrics["recall"]


def test_documented_accuracy(spark):
    counted = StagedRun(catalog(spark, DATA)).run(FLAGSHIP.with_func("COUNT"))
    assert counted["re"] == pytest.approx(0.0114, abs=1e-4)


def test_filters_and_columns_reach_the_scan(spark):
    plan = physical(relational.exact(catalog(spark, DATA), STAR))
    assert "GreaterThanOrEqual(l_discount,0.05)" in plan and "EqualTo(s_nationkey,3)" in plan
    assert "l_tax" not in plan and "l_shipdate" not in plan


def test_bernoulli_scan_does_not_shuffle(spark):
    assert "Exchange" not in physical(scan_bernoulli(catalog(spark, DATA), "events", 0.1))


def test_physical_locators(spark):
    rows = scan_with_locator(catalog(spark, DATA), "events", physical=True)
    wanted = rows.where("event_id in (3, 5)").select("locator")
    assert sorted(r["event_id"] for r in fetch_by_locator(rows, wanted).collect()) == [3, 5]


def test_predicates_are_checked():
    with pytest.raises(ValueError):
        Predicate("x", "<>", 1)
    with pytest.raises(ValueError):
        AggQuery("MAX", "x", "t", "g")
    with pytest.raises(ValueError):
        filters.route([Predicate("nowhere", "=", 1)], datasets.testdata(), ["events"])


def test_other_numeric_types(spark):
    rows = spark.sql("SELECT CAST(1.25 AS DECIMAL(9,2)) AS d, TIMESTAMP '2024-01-02 00:00:00' AS t")
    spec = datasets.TableSpec("m", {"d": "num", "t": "num"})
    assert filters.where_all(rows, [Predicate("d", ">=", "1.25"), Predicate("t", ">", "2024-01-01")], spec).count() == 1


def test_saved_answers_replay(spark):
    cat, place = catalog(spark, DATA), scratch_folder(spark) + "/replay"
    statements = spark.createDataFrame(
        [("w", 0, "SELECT user_id, COUNT(value) FROM events WHERE value > 20 GROUP BY user_id")], "workload string, line bigint, sql string"
    )
    metrics = workloads.run_workload(StagedRun(cat), statements, place, "test").first()
    assert metrics["error"] is None
    truth = read_truth(spark, place, "test", "w", 0, "bigint")
    again = StagedRun(cat).run(AggQuery("COUNT", "value", "events", "user_id", (Predicate("value", ">", 20),)), truth=truth)
    assert again["re"] == pytest.approx(metrics["re"]) and "ground_truth_latency" not in again


def test_scratch_folder_is_the_shared_one(spark):
    assert scratch_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    small = cut(spark.range(5).withColumn("x", F.rand(1)))
    assert "Range" not in physical(small) and small.collect() == small.collect()


def test_hot_key_answers(spark, hot_cat):
    """A third of all rows in one group and on one key, against plain pandas."""
    query = AggQuery("SUM", "x", "f", "g", (Predicate("n", "=", "even"), Predicate("x", ">=", 100)), JoinSpec("d", "k", "dk"))
    fact, dim = hot_cat.frame("f").toPandas(), hot_cat.frame("d").toPandas()
    rows = fact.merge(dim, left_on="k", right_on="dk")
    rows = rows[(rows.n == "even") & (rows.x >= 100)]
    assert {r["grp"]: r["value"] for r in relational.exact(hot_cat, query).collect()} == rows.groupby("g").x.sum().to_dict()
    metrics = StagedRun(hot_cat, RunConfig(topup_rows=1_000_000, count_mode="exact")).run(query)
    assert metrics["re_after_sampling_rare_groups"] == pytest.approx(0, abs=1e-9)
    few = StagedRun(hot_cat, RunConfig(topup_rows=4, count_mode="exact")).run(query)
    assert few["recall"] == 1.0 and few["re_after_sampling_rare_groups"] < 0.5


@pytest.fixture(scope="module")
def hot_cat(spark):
    i = F.col("id")
    fact = spark.range(30_000).select(
        "id",
        F.when(i % 3 == 0, -1).otherwise(i % 211).alias("g"),
        F.when(i % 3 == 1, 0).otherwise(i % 50).alias("k"),
        (i * 7919 % 1009).cast("double").alias("x"),
    )
    dim = spark.range(50).select(i.alias("dk"), F.when(i % 2 == 0, "even").otherwise("odd").alias("n"))
    specs = {
        "f": datasets.TableSpec("f", {"g": "int", "k": "int", "x": "num"}, ("id",), True, scales={"x": 0}),
        "d": datasets.TableSpec("d", {"dk": "int", "n": "str"}, ("dk",)),
    }
    return Catalog(spark, specs, {"f": fact.persist(), "d": dim}, "hot")


# --- workload text -----------------------------------------------------------------------


def profiled(spark, *statements):
    rows = [("w", i, s) for i, s in enumerate(statements)]
    return profile(spark.createDataFrame(rows, "workload string, line bigint, sql string")).orderBy("line").collect()


def test_workload_file(spark, tmp_path):
    (tmp_path / "w.sql").write_text("SELECT 1;\n\n  SELECT 2 ;\n")
    assert [r["sql"] for r in read_workload(spark, str(tmp_path), "w").orderBy("line").collect()] == ["SELECT 1", "SELECT 2"]


def test_statement_shapes(spark):
    rows = profiled(
        spark,
        "SELECT quarter, SUM(distance) FROM flights WHERE month = 12 AND depdelay > 265.99 AND deststatename = 'U.S. Virgin Islands' GROUP BY quarter",
        "select ss_quantity, avg(ss_list_price) from store_sales join store on ss_store_sk = s_store_sk where s_tax_percentage > 0.05 group by ss_quantity",
        "SELECT ss_quantity, COUNT(ss_list_price) FROM store_sales JOIN store ON s_store_sk = ss_store_sk GROUP BY ss_quantity",
        "SELECT g, AVG(x) FROM t WHERE a = 'O''Hare AND x > 3' GROUP BY g",
        "SELECT s.ss_quantity, AVG(store_sales.ss_list_price) FROM store_sales GROUP BY ss_quantity",
        "SELECT store_sales.ss_quantity, AVG(store_sales.ss_list_price) FROM store_sales JOIN store ON store.s_store_sk = store_sales.ss_store_sk"
        " WHERE Store.s_tax_percentage > 0.05 AND store_sales.ss_quantity = 3 AND s_city = 'a.b' GROUP BY ss_quantity",
        "SELECT g, AVG(x) FROM t WHERE a = 1 OR b = 2 GROUP BY g",
        "SELECT g, MAX(x) FROM t GROUP BY g",
        "SELECT g, AVG(x) FROM t GROUP BY h",
    )
    assert [r["supported"] for r in rows] == [True, True, True, True, False, True, False, False, False]
    specs = {**datasets.flights(), **datasets.store_sales(), "t": datasets.TableSpec("t", {"g": "str"})}
    queries = [to_query(r, lambda t: specs[t].kinds) for r in rows[:4]]
    assert queries[0].predicates[2] == Predicate("deststatename", "=", "U.S. Virgin Islands")
    assert queries[1].func == "AVG" and queries[1].join == JoinSpec("store", "ss_store_sk", "s_store_sk")
    assert queries[2].join == queries[1].join
    assert queries[3].predicates == (Predicate("a", "=", "O'Hare AND x > 3"),)
    named = to_query(rows[5], lambda t: specs[t].kinds)
    assert (named.group, named.measure, named.join) == ("ss_quantity", "ss_list_price", queries[1].join)
    assert [p.column for p in named.predicates] == ["s_tax_percentage", "ss_quantity", "s_city"]
    assert named.predicates[2].value == "a.b"
    with pytest.raises(ValueError):
        to_query(rows[4], lambda t: ())


def test_a_failing_statement_does_not_stop_the_run(spark):
    statements = spark.createDataFrame(
        [
            ("w", 0, "SELECT user_id, COUNT(value) FROM events WHERE absent = 1 GROUP BY user_id"),
            ("w", 1, "SELECT user_id, COUNT(value) FROM nowhere GROUP BY user_id"),
            ("w", 2, "SELECT event_type, COUNT(value) FROM events GROUP BY event_type"),
        ],
        "workload string, line bigint, sql string",
    )
    rows = workloads.run_workload(StagedRun(catalog(spark, DATA)), statements, parallel=2).orderBy("idx").collect()
    assert [r["error"] is None for r in rows] == [False, False, True]
    assert rows[2]["re"] == 0.0


def test_shared_scan_answers_a_hundred_statements(spark, hot_cat, tmp_path):
    draw = random.Random(4)
    join = JoinSpec("d", "k", "dk")
    queries = []
    for n in range(100):
        predicates = [Predicate("x", draw.choice([">", "<="]), draw.randrange(1009)), Predicate("g", "=", draw.choice([-1, 5, 300]))]
        picked = predicates[: draw.randrange(3)]
        if n % 4 == 3:
            picked = [*picked, Predicate("n", "=", "even")]
        func, group = draw.choice(["AVG", "SUM", "COUNT"]), draw.choice(["g", "k"])
        queries.append(AggQuery(func, "x", "f", group, tuple(picked), join if n % 4 == 3 else None))
    shared = workloads.shared_truths(hot_cat, [("w", i, q) for i, q in enumerate(queries)]).persist()
    single = workloads.shared_truths(hot_cat, [("w", i, q) for i, q in enumerate(queries) if q.join is None])
    assert single._jdf.queryExecution().executedPlan().toString().count("InMemoryTableScan") == 1
    for i in range(0, 100, 9):
        expected = {str(r["grp"]): r["value"] for r in exact(hot_cat, queries[i]).collect()}
        assert {r["grp"]: r["value"] for r in shared.where(F.col("idx") == i).collect()} == pytest.approx(expected, rel=1e-12)
    workloads.write_truths(shared, str(tmp_path), "hot")
    workloads.write_truths(shared.where("idx = 3"), str(tmp_path), "hot")
    again = read_truth(spark, str(tmp_path), "hot", "w", 9, "bigint")
    assert {r["grp"]: r["value"] for r in again.collect()} == pytest.approx({r["grp"]: r["value"] for r in exact(hot_cat, queries[9]).collect()})


def test_shared_scan_in_a_workload(spark, tmp_path):
    lines = ["SELECT user_id, AVG(value) FROM events WHERE value > 20 GROUP BY user_id", "SELECT event_type, COUNT(value) FROM events GROUP BY event_type"]
    lines += ["SELECT user_id, COUNT(value) FROM events WHERE absent = 1 GROUP BY user_id"]
    statements = spark.createDataFrame([("w", i, s) for i, s in enumerate(lines)], "workload string, line bigint, sql string")
    run = StagedRun(catalog(spark, DATA))
    rows = workloads.run_workload(run, statements, str(tmp_path), "e", parallel=3, shared_scan=True).orderBy("idx").collect()
    plain = workloads.run_workload(run, statements, parallel=3).orderBy("idx").collect()
    columns = [c for c in rows[0].asDict() if not c.endswith("_latency") and c != "error"]
    assert [[r[c] for c in columns] for r in rows] == [[r[c] for c in columns] for r in plain]
    assert [r["error"] is None for r in rows] == [True, True, False]


def test_metric_text(spark):
    metrics = metric_frame(spark, [{"idx": 3, "re": 0.123456, "num_of_bitmap_ops": 7}])
    row = formatted(metrics, ["idx", "re", "num_of_bitmap_ops", "recall", "unknown"]).first()
    assert tuple(row) == ("3", "0.1235", "7", None, None)


# --- a reference-shaped dataset -------------------------------------------------------------


@pytest.fixture(scope="module")
def flights_cat(spark):
    i = F.col("id")
    rows = spark.range(4000).select(
        "id",
        (i % 4 + 1).cast("int").alias("quarter"), (i % 12 + 1).cast("int").alias("month"),
        (i % 28 + 1).cast("int").alias("dayofmonth"), (i % 7 + 1).cast("int").alias("dayofweek"),
        F.concat(F.lit("AL"), (i % 9).cast("string")).alias("reporting_airline"),
        F.concat(F.lit("O"), (i % 31).cast("string")).alias("origin"),
        F.concat(F.lit("State "), (i % 13).cast("string")).alias("originstatename"),
        F.concat(F.lit("D"), (i % 37).cast("string")).alias("dest"),
        F.concat(F.lit("State "), (i % 17).cast("string")).alias("deststatename"),
        *[(i * k % 997 / 3.0).cast("float").alias(c) for k, c in
          ((3, "depdelay"), (5, "taxiout"), (7, "arrdelay"), (11, "taxiin"), (13, "airtime"), (17, "distance"))],
    )
    return Catalog(spark, datasets.flights(), {"flights": rows.persist()}, "flights")


@pytest.mark.parametrize("repair", ["topup", "generate"])
def test_statements_of_the_flights_shape(spark, flights_cat, repair):
    statements = spark.createDataFrame(
        [(f"w", i, s) for i, s in enumerate((
            "SELECT dayofweek, AVG(airtime) FROM flights WHERE month = 10 GROUP BY dayofweek",
            "SELECT dest, SUM(distance) FROM flights WHERE airtime > 230.79 AND quarter = 2 GROUP BY dest",
            "SELECT quarter, COUNT(distance) FROM flights WHERE dayofweek = 2 AND depdelay > 20.5 AND arrdelay < 165.82"
            " AND deststatename = 'State 3' GROUP BY quarter",
        ))],
        "workload string, line bigint, sql string",
    )
    config = RunConfig(repair=repair, topup_rows=5, max_batches=3)
    rows = workloads.run_workload(StagedRun(flights_cat, config), statements, parallel=3).orderBy("idx").collect()
    assert [r["error"] for r in rows] == [None] * 3
    stage = "re_after_sampling_rare_groups" if repair == "topup" else "re_after_supply_missing_groups"
    assert rows[0][stage] <= rows[0]["re_with_samples"]
    assert rows[1]["re_after_dynamic_supply"] < 1 and rows[2]["re"] < 1
    assert rows[1]["recall"] == 1.0


def test_levels_of_a_stored_model_are_looked_up_once(spark, tmp_path):
    cat = catalog(spark, DATA)
    model = StoredModel(spark, cat.spec("events"), FLAGSHIP.group, str(tmp_path))
    model.add("all", cat.frame("events"))
    first = model.levels()
    spark.sparkContext.setJobGroup("levels", "levels")
    try:
        again = model.levels()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert spark.sparkContext.statusTracker().getJobIdsForGroup("levels") == [] and again == first
    model.add("more", cat.frame("events"))
    assert model.levels()[1].first()["fit_rows"] == 2 * first[1].first()["fit_rows"]
