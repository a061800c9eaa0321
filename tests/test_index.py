import itertools

import pytest
from pyspark.sql import functions as F

from thingroups import AggQuery, Catalog, JoinSpec, Predicate, TableSpec
from thingroups.operators import bitmaps, groups
from thingroups.operators.relational import exact
from thingroups.sources.storage import BitmapIndex, is_written, scratch_folder

SPECS = {
    "fact": TableSpec("fact", {"g": "int", "c": "str", "d": "int", "x": "num", "y": "num"}, ("id",), True),
    "dim": TableSpec("dim", {"k": "int", "name": "str"}, ("k",)),
}


@pytest.fixture(scope="module")
def cat(spark):
    """100,000 rows: value 'hot' holds a third of them, so containers of both forms occur."""
    rid = F.col("id")
    fact = spark.range(100_000).select(
        "id",
        F.when(rid % 3 == 0, 0).otherwise(rid % 5003).alias("g"),
        F.when(rid % 3 == 0, "hot").otherwise(F.concat(F.lit("c"), (rid % 7).cast("string"))).alias("c"),
        (rid % 11).alias("d"),
        F.when(rid % 50 != 0, (rid * 37 % 1001).cast("double")).alias("x"),
        F.lit(2.5).alias("y"),
    )
    dim = spark.createDataFrame([(i, "odd" if i % 2 else "even") for i in range(11)], "k bigint, name string")
    return Catalog(spark, SPECS, {"fact": fact.persist(), "dim": dim}, "test_index")


@pytest.fixture(scope="module")
def index(cat):
    made = BitmapIndex(cat, "fact", scratch_folder(cat.spark))
    made.write()
    return made


def counts(df):
    return {r[0]: r[1] for r in df.collect()}


def binned_truth(cat, index, predicates, keys=None):
    """The same prediction row by row in pandas."""
    import numpy as np

    frame = cat.frame("fact").toPandas()
    keep = np.ones(len(frame), bool)
    for p in predicates:
        column = frame[p.column]
        if SPECS["fact"].kinds[p.column] != "num":
            value = int(p.value) if SPECS["fact"].kinds[p.column] == "int" else p.value
            keep &= {"=": column == value, ">=": column >= value if p.op != "=" else None}[p.op].to_numpy()
            continue
        lo, hi = cat.bounds("fact")[p.column]
        width = (hi - lo) / 100
        bins = np.minimum(np.floor((column - lo) / width), 99)
        at = -1 if p.value < lo else 100 if p.value >= hi else int((p.value - lo) // width)
        keep &= (bins > at if p.op in (">", ">=") else bins < at).to_numpy()
    if keys is not None:
        keep &= frame["d"].isin(keys).to_numpy()
    return frame[keep].groupby("g").size().to_dict()


PREDICATES = [
    Predicate("c", "=", "hot"),
    Predicate("x", ">", 250.0),
    Predicate("x", "<=", 777.7),
    Predicate("d", ">=", 6),
    Predicate("c", "=", "c3"),
]


@pytest.mark.parametrize("picked", [p for n in (1, 2, 3) for p in itertools.combinations(PREDICATES, n)][::2])
def test_bitmap_path_equals_row_path(cat, index, picked):
    query = AggQuery("COUNT", "x", "fact", "g", picked)
    assert counts(groups.predict_groups(cat, query, index)) == binned_truth(cat, index, picked)


def test_both_container_forms_exist(index):
    stats = {r["column"]: r for r in bitmaps.storage_stats(index.read()).collect()}
    assert stats["c"]["dense_containers"] > 0 and stats["g"]["dense_containers"] > 0
    assert stats["g"]["containers"] > stats["g"]["dense_containers"]
    assert stats["g"]["entries"] == 100_000 and stats["x"]["entries"] == 98_000
    for row in stats.values():
        assert row["adaptive_bytes"] <= min(row["dense_bytes"], row["list_bytes"])


def test_layouts_agree(cat, index):
    lines = bitmaps.entries(index.rows(), index.spec, cat.bounds("fact"), columns=["c", "x"])
    held = F.coalesce(F.bitmap_count("bitmap"), F.size("positions"))
    both = [
        {tuple(r) for r in bitmaps.build(lines, layout).select("column", "value", "bucket", held, "n").collect()}
        for layout in ("adaptive", "dense")
    ]
    assert both[0] == both[1]


def test_join_reduction_and_empty_dimension(cat, index):
    query = AggQuery("COUNT", "x", "fact", "g", (Predicate("name", "=", "odd"), Predicate("c", "=", "hot")), JoinSpec("dim", "d", "k"))
    odd = [1, 3, 5, 7, 9]
    assert counts(groups.predict_groups(cat, query, index)) == binned_truth(cat, index, [Predicate("c", "=", "hot")], odd)
    none = AggQuery("COUNT", "x", "fact", "g", (Predicate("name", "=", "neither"),), JoinSpec("dim", "d", "k"))
    assert groups.predict_groups(cat, none, index).isEmpty()
    assert groups.group_counts(cat, none).isEmpty()
    assert exact(cat, none).isEmpty()


def test_no_predicate_means_all_rows(cat, index):
    query = AggQuery("COUNT", "x", "fact", "c")
    expected = counts(cat.frame("fact").groupBy("c").count())
    assert counts(groups.predict_groups(cat, query, index)) == expected
    assert counts(groups.group_counts(cat, query)) == expected


@pytest.mark.parametrize("mode", ["interpolate", "reference", "exact"])
@pytest.mark.parametrize("op, v", [(">", 5000), ("<", -5)])
def test_literal_outside_the_domain(cat, mode, op, v):
    query = AggQuery("COUNT", "x", "fact", "g", (Predicate("x", op, v),))
    assert groups.group_counts(cat, query, mode).isEmpty()


@pytest.mark.parametrize("op, rows", [(">=", 100_000), (">", 0)])
def test_constant_column(cat, index, op, rows):
    query = AggQuery("COUNT", "x", "fact", "c", (Predicate("y", op, 2.5),))
    assert sum(counts(groups.group_counts(cat, query)).values()) == rows


def test_unknown_value_predicts_nothing(cat, index):
    query = AggQuery("COUNT", "x", "fact", "g", (Predicate("c", "=", "nothing"), Predicate("x", ">", 1)))
    assert groups.predict_groups(cat, query, index).isEmpty()


def test_exact_mode_at_full_rate_is_the_truth(cat):
    query = AggQuery("COUNT", "d", "fact", "g", (Predicate("x", ">", 250.0), Predicate("c", "=", "hot")))
    assert counts(groups.group_counts(cat, query, "exact")) == counts(exact(cat, query))


def test_closed_index_gives_reference_counts(cat):
    closed = BitmapIndex(cat, "fact", scratch_folder(cat.spark), closed=True)
    closed.write()
    for predicates in ([Predicate("x", ">", 250.0)], [Predicate("x", "<=", 600.0), Predicate("c", "=", "hot")],
                       [Predicate("x", ">", 100.0), Predicate("x", "<", 600.0)]):
        query = AggQuery("COUNT", "x", "fact", "g", tuple(predicates))
        mine = counts(groups.bitmap_group_counts(cat, query, closed))
        rows = counts(groups.group_counts(cat, query, "reference"))
        assert mine.keys() == rows.keys()
        assert all(mine[g] == pytest.approx(rows[g]) for g in rows)


def test_index_rate_scales_counts(spark, cat):
    specs = {**SPECS, "fact": TableSpec("fact", SPECS["fact"].kinds, ("id",), True, index_rate=0.25)}
    thin = Catalog(spark, specs, cat.frames, "test_index_thin")
    query = AggQuery("COUNT", "d", "fact", "c", (Predicate("d", ">=", 6),))
    estimate, truth = counts(groups.group_counts(thin, query)), counts(exact(cat, query))
    assert all(abs(estimate[g] / truth[g] - 1) < 0.1 for g in truth)
    index = BitmapIndex(thin, "fact", scratch_folder(spark))
    index.write()
    assert 24_000 < index.rows().count() < 26_000
    predicted = counts(groups.predict_groups(thin, query, index))
    assert {g: n / 0.25 for g, n in predicted.items()} == estimate


def test_written_once_and_partitioned(cat, index):
    assert is_written(cat.spark, index.bitmaps_path)
    before = index.read().count()
    index.write()
    assert index.read().count() == before
    one = index.read("c", ["hot"])
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(column" in plan and "EqualTo(value,hot)" in plan
    assert not is_written(cat.spark, index.bitmaps_path + "_absent")


def test_bucketed_index_needs_no_shuffle_on_bucket(cat, index):
    saved = index.save_bucketed("test_bucketed_index", 4)
    assert saved.count() == index.read().count()
    sets = saved.where("column = 'c'").groupBy("bucket").agg(F.bitmap_or_agg("bitmap"))
    assert "Exchange" not in sets._jdf.queryExecution().sparkPlan().toString()
    cat.spark.sql("DROP TABLE test_bucketed_index")
