"""Stored artefacts under threads and after aborted writes; keys, ties and literals at their edges."""

from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from thingroups.functions import binning
from thingroups.operators import bitmaps, generate, sampling
from thingroups.operators.filters import where_all
from thingroups.sources.catalog import fetch_by_locator, key_parts
from thingroups.sources.storage import is_written, write_once
from thingroups.spec import Predicate, TableSpec

SPEC = TableSpec("t", {"a": "str", "b": "str", "c": "str", "x": "num"}, ("a", "b", "c", "x"), is_fact=True)


def test_eight_threads_write_one_artefact(spark, tmp_path):
    df = spark.range(1_000).withColumn("v", F.col("id") % 7)
    with ThreadPoolExecutor(8) as pool:
        counts = list(pool.map(lambda _: write_once(df, f"{tmp_path}/x").count(), range(8)))
    assert counts == [1_000] * 8
    assert len(list(Path(tmp_path, "x").glob("data-*"))) == 1


def test_half_written_artefacts_are_written_again(spark, tmp_path):
    path = f"{tmp_path}/y"
    df = spark.range(100).repartition(4)
    df.write.parquet(f"{path}/data-aborted")
    assert not is_written(spark, path)
    write_once(df, path)
    (folder,) = {p.parent for p in Path(path).glob("data-*/*.parquet") if p.parent.name != "data-aborted"}
    lost = sorted(folder.glob("*.parquet"))[0]
    for p in (lost, folder / f".{lost.name}.crc"):
        p.unlink()
    assert not is_written(spark, path)
    assert write_once(df, path).count() == 100 and is_written(spark, path)


def test_models_of_two_datasets_in_one_folder(spark, tmp_path):
    spec = TableSpec("t", {"g": "int", "v": "num"}, ("v",), is_fact=True)
    one = spark.createDataFrame([(1, 1.0), (2, 3.0)], "g int, v double")
    two = spark.createDataFrame([(5, 9.0)], "g int, v double")
    for df, name in ((one, "one"), (two, "two"), (one, "one")):
        fitted = generate.load_or_fit(df, spec, "g", str(tmp_path), dataset=name)
        assert fitted.by_group.count() == df.count()
    with ThreadPoolExecutor(6) as pool:
        found = pool.map(lambda _: generate.load_or_fit(one, spec, "g", f"{tmp_path}/threads").by_group.count(), range(6))
    assert list(found) == [2] * 6


def test_locators_differ_where_keys_differ(spark):
    rows = [("a", None, "b", 1.0), ("a", "b", None, 1.0), ("a|b", None, None, 1.0), ("a", "b", "\\N", 1.0), ("a", "b", None, 1e-7)]
    rows += [("a", "b", None, 2e-7), ("a", "b", None, 1e13), ("a", "b", None, None)]
    df = spark.createDataFrame(rows, "a string, b string, c string, x double")
    located = df.withColumn("locator", F.concat_ws("|", *key_parts(df, SPEC)))
    assert located.select("locator").distinct().count() == len(rows)
    for r in located.collect():
        assert fetch_by_locator(located, located.where(F.col("locator") == F.lit(r["locator"]))).count() == 1


@pytest.mark.parametrize("rate, rows", [(1 / 3, 3), (0.5, 10), (0.25, 40)])
def test_exact_samples_with_equal_keys(spark, rate, rows):
    df = spark.createDataFrame([(None, None, None, float(i % 2)) for i in range(rows)], "a string, b string, c string, x double")
    spec = TableSpec("t", SPEC.kinds, ("a", "b"), is_fact=True)
    assert sampling.exact_sample(df, spec, rate).count() == round(rate * rows)
    train, held = sampling.train_validation_split(df, spec, 0.2)
    assert held.count() == -(-rows // 5) and train.count() + held.count() == rows


def test_fractions_against_whole_numbers(spark):
    spec = TableSpec("t", {"k": "int"}, ("k",), is_fact=True)
    df = spark.createDataFrame([(2,), (3,), (4,)], "k int")
    for value in (3.5, "3.5"):
        for op, expected in (("<", [2, 3]), ("<=", [2, 3]), (">", [4]), (">=", [4]), ("=", [])):
            got = sorted(r["k"] for r in where_all(df, [Predicate("k", op, value)], spec).collect())
            assert got == expected, (op, value)
    index = bitmaps.build(bitmaps.entries(df.withColumn("rid", F.col("k").cast("bigint")), spec, {}), "adaptive")
    assert bitmaps.set_size(bitmaps.range_set(index, Predicate("k", ">=", 3.5), spec, {})).first()["n"] == 1


def test_closed_comparisons_at_the_ends(spark):
    df = spark.createDataFrame([(float(x),) for x in (0, 0, 1, 50, 99, 100, 100, 100)], "x double")
    for op, v, expected in ((">=", 100, 3.0), ("<=", 0, 2.0), (">=", 0, 8.0), ("<=", 100, 8.0), (">", 100, 0.0), ("<", 0, 0.0)):
        weight = binning.range_weight(F.col("x"), op, float(v), 0.0, 100.0, 100)
        assert df.agg(F.sum(weight)).first()[0] == expected, (op, v)
        first, last = binning.full_bins(op, float(v), 0.0, 100.0, 100)
        if expected:
            assert spark.range(1).select((first <= last).alias("some")).first()["some"], (op, v)
    assert spark.range(1).select(binning.boundary_fraction("<=", 50.0, 0.0, 100.0, 100)).first()[0] > 0


def test_hot_join_keys_are_added_up_before_the_join(spark):
    from thingroups import AggQuery, Catalog, JoinSpec
    from thingroups.operators.groups import group_counts
    from thingroups.operators.relational import exact

    fact = TableSpec("f", {"k": "int", "x": "num"}, ("k", "x"), is_fact=True, scales={"x": 2})
    dim = TableSpec("d", {"dk": "int", "w": "num"}, ("dk", "w"))
    rows = spark.range(3_000).selectExpr("cast(if(id % 3 = 0, id % 40, 7) as int) as k", "cast(if(id % 11 = 0, null, id % 13) as double) as x")
    dims = spark.createDataFrame([(i, float(i % 5)) for i in range(30)] + [(7, 4.0)], "dk int, w double")
    cat = Catalog(spark, {"f": fact, "d": dim}, {"f": rows, "d": dims}, name="hot")
    rows.createOrReplaceTempView("f")
    dims.createOrReplaceTempView("d")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for func in ("AVG", "SUM", "COUNT"):
            for group in ("k", "dk"):
                query = AggQuery(func, "x", "f", group, (Predicate("w", ">", 0), Predicate("x", ">=", 1)), JoinSpec("d", "k", "dk"))
                sql = f"SELECT {group}, {func}(x) FROM f JOIN d ON k = dk WHERE w > 0 AND x >= 1 GROUP BY 1"
                expected = {r[0]: pytest.approx(float(r[1])) for r in spark.sql(sql).collect()}
                answered = exact(cat, query)
                assert {r["grp"]: r["value"] for r in answered.collect()} == expected
                assert "Exchange hashpartitioning(k" in answered._jdf.queryExecution().toString()
                plan = answered._jdf.queryExecution().optimizedPlan().toString()
                assert plan.index("Join") < plan.rindex("Aggregate")  # an aggregate stands below the join
        counted = group_counts(cat, AggQuery("COUNT", "x", "f", "k", (Predicate("w", ">", 0),), JoinSpec("d", "k", "dk")))
        sql = "SELECT k, COUNT(*) FROM f WHERE k IN (SELECT dk FROM d WHERE w > 0) GROUP BY 1"
        assert {r["grp"]: r["est_count"] for r in counted.collect()} == {r[0]: r[1] for r in spark.sql(sql).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
