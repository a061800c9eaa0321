import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thingroups import AggQuery, Catalog, Predicate, RunConfig, TableSpec
from thingroups.operators import generate, relational, repair, sampling
from thingroups.operators.partial_fit import StoredModel
from thingroups.plans.staged import StagedRun
from thingroups.sources.datasets import flights, store_sales
from thingroups.sources.storage import BitmapIndex

SPEC = TableSpec("t", {"g": "str", "c": "str", "x": "num"}, ("id",), True)


@pytest.fixture(scope="module")
def rows(spark):
    data = [
        (1, "a", "p", 1.0), (2, "a", "p", 3.0), (3, "a", "q", 8.0),
        (4, "b", "q", 10.0), (5, "b", None, 99.0), (6, "c", "q", None),
    ]
    return spark.createDataFrame(data, "id bigint, g string, c string, x double")


def test_levels_back_off(spark, rows):
    fitted = generate.fit(rows, SPEC, "g", [Predicate("c", "=", "p")])
    blank = spark.createDataFrame([("a", "p", None), ("b", "p", None), ("c", "p", None), ("a", None, None)], "g string, c string, x double")
    filled = [tuple(r) for r in generate.impute(blank, fitted).orderBy("g", "c").collect()]
    # a: group and equality; b: only the group; c: no complete row at all, overall.
    assert ("a", "p", 2.0) in filled and ("b", "p", 10.0) in filled
    assert ("c", "p", 5.5) in filled


def test_known_cells_stay(spark, rows):
    fitted = generate.fit(rows, SPEC, "g")
    known = spark.createDataFrame([("a", "z", 7.0)], "g string, c string, x double")
    assert tuple(generate.impute(known, fitted).first()) == ("a", "z", 7.0)


def test_mode_ties_go_to_the_smaller_text(spark):
    rows = spark.createDataFrame([(1, "a", "q", 1.0), (2, "a", "p", 1.0)], "id bigint, g string, c string, x double")
    assert generate.fit(rows, SPEC, "g").by_group.first()["c"] == "p"


def test_condition_rows_on_flights(spark):
    spec = flights()["flights"]
    types = {c: {"int": "int", "str": "string", "num": "float"}[k] for c, k in spec.kinds.items()}
    wanted = spark.createDataFrame([("ABE",)], "grp string")
    made = generate.condition_rows(
        wanted, [Predicate("airtime", ">", 10), Predicate("month", "=", 4)], "dest", spec,
        {c: spark.createDataFrame([], f"x {t}").schema[0].dataType for c, t in types.items()}, {"airtime": (0.0, 50.0)}, 3,
    ).collect()
    assert len(made) == 3 and len({r["airtime"] for r in made}) == 3
    assert all(r["month"] == 4 and r["dest"] == "ABE" and 10 <= r["airtime"] <= 50 and r["origin"] is None for r in made)


def test_sampled_fill_draws_every_donor(spark, monkeypatch):
    monkeypatch.setattr(generate, "REQUESTS_PER_PART", 100)  # six parts a pool
    donors = spark.range(40).select("id", F.when(F.col("id") < 30, "hot").otherwise("cold").alias("g"), F.lit("p").alias("c"), F.col("id").cast("double").alias("x"))
    asks = spark.createDataFrame([("hot", None, None), ("cold", None, None), ("new", None, None)], "g string, c string, x double")
    drawn = generate.impute_sampled(asks, donors, SPEC, "g", ["g"], (), 600).collect()
    assert len(drawn) == 1800
    seen = {g: {r["x"] for r in drawn if r["g"] == g} for g in ("hot", "cold", "new")}
    assert seen["hot"] == set(map(float, range(30))) and seen["cold"] == set(map(float, range(30, 40)))
    assert seen["new"] == set(map(float, range(40)))  # no donor of its own: any row
    share = sum(r["x"] < 15 for r in drawn if r["g"] == "hot") / 600
    assert abs(share - 0.5) < 0.08


def test_distributed_rank_is_a_plain_rank(spark):
    rows = spark.range(5000).select((F.col("id") % 2).alias("p"), "id", F.md5(F.col("id").cast("string")).alias("h"))
    ranked = generate.distributed_rank(rows, ["p"], F.col("h"), ["id"], digits=1).collect()
    for p in (0, 1):
        mine = sorted((r for r in ranked if r["p"] == p), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 2501))
        assert [r["h"] for r in mine] == sorted(r["h"] for r in mine)


def test_encode_and_decode(spark, rows):
    codes = generate.category_dictionary(rows, ["g", "c"])
    assert sorted(r["code"] for r in codes.where("column = 'g'").collect()) == [0, 1, 2]
    coded = generate.category_encode(rows, codes, ["g", "c"])
    back = generate.category_decode(coded, codes, {c: rows.schema[c].dataType for c in ("g", "c")})
    assert sorted(map(str, back.select(rows.columns).collect())) == sorted(map(str, rows.collect()))


def test_null_cells_stay_hidden(spark, rows):
    assert generate.mask_random(rows, SPEC, 0.0).where("id = 5").first()["c"] is None
    assert generate.mask_random(rows, SPEC, 1.0).select("g", "c", "x").distinct().collect() == [(None, None, None)]


def test_acceptance_is_certain_where_data_is_denser(spark):
    data = spark.range(100).select("id", F.when(F.col("id") < 90, "p").otherwise("q").alias("c"))
    made = spark.range(1000).select("id", F.when(F.col("id") < 500, "p").otherwise("q").alias("c"))
    kept = {r["c"]: r["count"] for r in generate.accept_by_density(made, data, "c", ["id"]).groupBy("c").count().collect()}
    assert kept["p"] == 500 and 60 < kept["q"] < 140


# --- supply ------------------------------------------------------------------------


def test_batches_stand_until_the_first_rejection(spark):
    sample = spark.createDataFrame([(x,) for x in (1.0, 5.0, 9.0, 13.0)], "x double")
    batches = spark.createDataFrame(
        [("a", 1, 7.0), ("a", 1, 7.0), ("a", 2, 900.0), ("a", 3, 7.0), ("b", 1, 800.0)], "grp string, batch int, x double"
    )
    judged = repair.accept_by_cv(batches, "x", repair.sample_moments(sample, "x"))
    found = {(r["grp"], r["batch"]): r["accepted"] for r in judged.collect()}
    assert found == {("a", 1): True, ("a", 2): False, ("a", 3): False, ("b", 1): False}
    first = judged.where("grp = 'a' and batch = 1").first()
    import statistics

    before = [1, 5, 9, 13]
    assert first["cv_before"] == pytest.approx(statistics.stdev(before) / statistics.mean(before))
    after = [*before, 7, 7]
    assert first["cv_after"] == pytest.approx(statistics.stdev(after) / statistics.mean(after))
    best = repair.best_reward(judged).first()
    assert (best["grp"], best["accepted_batches"]) == ("a", 1)


def test_empty_sample_accepts_nothing(spark):
    sample = spark.createDataFrame([], "x double")
    batches = spark.createDataFrame([("a", 1, 7.0)], "grp string, batch int, x double")
    assert repair.sample_moments(sample, "x") == (0, 0.0, 0.0)
    assert not repair.accept_by_cv(batches, "x", (0, 0.0, 0.0)).first()["accepted"]


def test_allocation_exploits_and_retires():
    race = [{"round": t, "place": p, "grp": g, "n": 5, "score": float(p)} for t in range(1, 7) for p, g in ((1, "a"), (2, "b"))]
    judged = {("a", 1): (True, 0.5), ("a", 2): (True, 0.1), ("a", 3): (False, None), ("b", 1): (False, None)}
    greedy = repair.allocate(race, judged, 6, 10, 0.0, 42)
    # Never exploring except when nothing is known: a until it is retired, then b once, then nothing is left.
    assert greedy.picks == ["a", "a", "a", "b"] and greedy.accepted == {"a": 2}
    assert repair.allocate([], {}, 6, 10, 0.5, 42).picks == []


def test_store_sales_declares_a_star():
    specs = store_sales()
    assert specs["store_sales"].is_fact and not specs["store"].is_fact
    assert flights("flights_100m")["flights"].index_rate == 0.2


MODEL_SPEC = TableSpec("t", {"g": "int", "c": "str", "k": "int", "x": "num", "y": "num"}, ("id",), True, scales={"x": 2})


def model_rows(spark, n=3_000):
    i = F.col("id")
    return spark.range(n).select(
        "id",
        F.when(i % 3 == 0, 0).when(i % 50 == 1, None).otherwise(i % 17).cast("bigint").alias("g"),
        F.when(i % 11 != 0, F.concat(F.lit("c"), (i * 7 % 5).cast("string"))).alias("c"),
        (i % 4).alias("k"),
        F.round((i * 37 % 1001) / 100, 2).alias("x"),
        F.when(i % 13 != 0, (i % 29) / 3).alias("y"),
    )


def test_parts_merge_into_the_fit_of_the_whole(spark, tmp_path):
    rows = model_rows(spark).persist()
    whole = generate.fit(rows, MODEL_SPEC, "g")
    model = StoredModel(spark, MODEL_SPEC, "g", str(tmp_path))
    with pytest.raises(ValueError):
        model.levels()
    for n, (a, b) in enumerate([(0, 10), (10, 1_500), (1_500, 1_501), (1_501, 3_000)]):
        model.add(f"p{n}", rows.where((F.col("id") >= a) & (F.col("id") < b)))
        if n == 1:
            early = model.levels()[1].first()["fit_rows"]
    by_group, overall = model.levels()
    assert early < overall.first()["fit_rows"]
    columns = ["fit_rows", "c", "k", "x"]
    for mine, theirs, key in ((by_group, whole.by_group, ["grp"]), (overall, whole.overall, [])):
        got, expected = ({tuple(r[c] for c in key): r for r in df.collect()} for df in (mine, theirs))
        assert got.keys() == expected.keys()
        for g in got:
            assert [str(got[g][c]) for c in columns] == [str(expected[g][c]) for c in columns]
            assert got[g]["y"] == pytest.approx(expected[g]["y"], rel=1e-12)
    # a part that is there is not read again, and a new model over the folder finds all parts
    again = StoredModel(spark, MODEL_SPEC, "g", str(tmp_path))
    for n in range(4):
        again.add(f"p{n}", rows.where(F.raise_error(F.lit("read again")).cast("boolean")))
    assert again.levels()[1].first() == overall.first()


def test_a_run_after_start_up_reads_no_fact_row(spark, tmp_path):
    rows = model_rows(spark).where("g IS NOT NULL")
    rows.write.parquet(f"{tmp_path}/t.parquet")
    cat = Catalog.from_files(spark, {"t": MODEL_SPEC}, str(tmp_path), name="started")
    query = AggQuery("AVG", "x", "t", "g", (Predicate("c", "=", "c1"), Predicate("y", ">", 3.5)))
    samples = sampling.cached_sample(cat, 0.1, folder=str(tmp_path))
    index = BitmapIndex(cat, "t", str(tmp_path))
    index.write()
    model = StoredModel(spark, MODEL_SPEC, "g", str(tmp_path))
    model.add("all", cat.frame("t"))
    truth = relational.exact(cat, query).persist()
    truth.count()
    run = StagedRun(cat, RunConfig(repair="generate"), samples, index, models={("t", "g"): model})
    usual = run.run(query, truth=truth)
    cat.frames["t"] = cat.frames["t"].where(F.raise_error(F.lit("a fact row was read")).cast("boolean"))
    assert run.run(query, truth=truth).keys() == usual.keys()


@pytest.mark.parametrize("seed, epsilon", [(1, 0.0), (2, 0.5), (3, 1.0), (42, 0.5)])
def test_the_fold_allocates_as_the_loop_does(spark, seed, epsilon):
    draw = random.Random(seed)
    sizes = spark.createDataFrame([(f"g{i}", draw.randrange(1, 400)) for i in range(12)], "grp string, n bigint")
    race = repair._race(sizes, 9, seed)
    lines, judged = [], {}
    for i in range(12):
        limit = draw.choice([0, 1, 2, 9])
        for batch in range(1, 10):
            judged[f"g{i}", batch] = (batch <= limit, draw.random())
            lines.append((f"g{i}", batch, *judged[f"g{i}", batch]))
    plan = repair.allocate(race.collect(), judged, 9, 10, epsilon, seed)
    table = spark.createDataFrame(lines, "grp string, batch int, accepted boolean, reward double")
    found = repair.allocation(race, table, 9, 10, epsilon, seed, T.StringType())
    assert {r["grp"]: r["upto"] for r in found.collect()} == plan.accepted
    none = repair.allocation(race.limit(0), table.limit(0), 9, 10, epsilon, seed, T.StringType())
    assert none.collect() == []
