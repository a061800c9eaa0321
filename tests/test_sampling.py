from hashlib import md5

import pytest
from pyspark.sql import functions as F

from thingroups.functions.draws import digest, keep, unit
from thingroups.operators import sampling
from thingroups.operators.relational import group_sizes
from thingroups.sources.catalog import key_parts
from thingroups.spec import TableSpec

SPEC = TableSpec("t", {"g": "str", "x": "num"}, ("id",), True)


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows in one group, the rest over many small ones."""
    g = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("g"), (F.col("id") % 701).cast("string")))
    return spark.range(30_000).select("id", g.alias("g"), (F.col("id") % 97).cast("double").alias("x")).persist()


def hashed(salt, key):
    return md5(f"{salt}|{key}".encode()).hexdigest()


def test_draws_are_plain_md5(spark):
    row = spark.range(7, 8).select(digest("s|42", "id").alias("h"), unit("s|42", "id").alias("u")).first()
    assert row["h"] == hashed("s|42", 7)
    assert row["u"] == int(row["h"][:8], 16) / 2**32


@pytest.mark.parametrize("algo", ["md5", "xxhash64"])
def test_bernoulli_does_not_depend_on_partitions(spark, algo):
    a = spark.range(20_000).repartition(13).where(keep(0.1, "s", "id", algo=algo))
    b = spark.range(20_000).coalesce(1).where(keep(0.1, "s", "id", algo=algo))
    ids = {r["id"] for r in a.collect()}
    assert ids == {r["id"] for r in b.collect()}
    assert 1700 < len(ids) < 2300
    assert spark.range(9).where(keep(1, "s", "id")).count() == 9
    assert spark.range(9).where(keep(0, "s", "id")).count() == 0


@pytest.mark.parametrize("rate", [0.0, 0.0123, 0.5, 1.0])
def test_exact_sample(skewed, monkeypatch, rate):
    monkeypatch.setattr(sampling, "CELL_ROWS", 0)  # look four digits deeper at every step
    wanted = round(30_000 * rate)
    expected = set(sorted(range(30_000), key=lambda i: hashed("u1|42", i))[:wanted])
    assert {r["id"] for r in sampling.exact_sample(skewed, SPEC, rate).collect()} == expected


def test_split_is_a_partition(skewed):
    train, held = sampling.train_validation_split(skewed, SPEC)
    assert held.count() == 4500 and train.count() == 25_500
    assert train.join(held, "id").count() == 0


def test_rare_groups(spark):
    predicted = spark.createDataFrame([("a",), ("b",), ("c",)], "grp string")
    sizes = spark.createDataFrame([("a", 5), ("b", 1)], "grp string, n bigint")
    found = {r["grp"]: (r["n"], r["need"]) for r in sampling.rare_groups(predicted, sizes, 3).collect()}
    assert found == {"b": (1, 2), "c": (0, 3)}


def test_topup_takes_what_is_needed_and_there(spark):
    rows = spark.createDataFrame(
        [(i, g) for i, g in enumerate("a" * 9 + "b" + "c" * 8)], "id bigint, g string"
    )
    rare = spark.createDataFrame([("b", 1, 2), ("c", 0, 3)], "grp string, n bigint, need bigint")
    taken = sampling.topup_rows(rows, "g", rare, 3, [F.col("id").cast("string")])
    assert {r["grp"]: r["n"] for r in group_sizes(taken, "g").collect()} == {"b": 1, "c": 3}


def test_topup_with_a_hot_group(spark, skewed):
    rare = skewed.select(F.col("g").alias("grp")).distinct().select("grp", F.lit(0).alias("n"), F.lit(4).alias("need"))
    taken = sampling.topup_rows(skewed, "g", rare, 4, key_parts(skewed, SPEC))
    frame = skewed.toPandas()
    frame["h"] = [hashed("topup|42", i) for i in frame["id"]]
    expected = frame.sort_values("h").groupby("g").head(4)
    assert {r["id"] for r in taken.collect()} == set(expected["id"])
    plan = taken._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan  # rows are dropped before the shuffle


def test_union_coerces_and_fills(spark):
    sample = spark.createDataFrame([(1, "a", 0.5)], "id bigint, g string, x double")
    more = spark.createDataFrame([("2", "b")], "id string, g string")
    both = sampling.union_rows(sample, more)
    assert both.schema == sample.schema
    assert sorted(tuple(r) for r in both.collect()) == [(1, "a", 0.5), (2, "b", None)]


def test_supply_weight(spark):
    rows = spark.createDataFrame([(0,), (100,), (300,)], "n bigint")
    assert [r["w"] for r in rows.select(sampling.supply_weight(F.col("n")).alias("w")).collect()] == [1.0, 0.5, 0.25]


def test_weighted_choice_follows_the_weights(spark):
    groups = spark.createDataFrame([("thin", 0), ("thick", 300)], "grp string, n bigint")
    weight = sampling.supply_weight(F.col("n"))
    drawn = groups.select("*", F.explode(F.sequence(F.lit(1), F.lit(4000))).alias("d")).select(
        "d", "grp", sampling.choice_score(F.col("grp"), weight, F.col("d")).alias("s")
    )
    wins = drawn.groupBy("d").agg(F.min_by("grp", "s").alias("grp")).where("grp = 'thin'").count()
    assert abs(wins / 4000 - 0.8) < 0.03


def test_native_sampling(skewed):
    assert 2400 < sampling.uniform_sample(skewed, SPEC, 0.1, native=True).count() < 3600
