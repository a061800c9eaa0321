"""The packed index: slices, one pass, join index, rows by id, choice of rows on the index."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from thingroups import AggQuery, Catalog, JoinSpec, Predicate, TableSpec
from thingroups.functions import binning
from thingroups.operators import factors, groups, packing, sampling
from thingroups.operators.filters import where_all
from thingroups.sources.storage import BitmapIndex

SPECS = {
    "fact": TableSpec("fact", {"g": "int", "c": "str", "d": "int", "x": "num", "y": "num", "void": "num"}, ("id",), True),
    "dim": TableSpec("dim", {"k": "int", "name": "str", "level": "num", "size": "int"}, ("k",)),
}
FILES, ROWS = 6, 120_000
STAR = JoinSpec("dim", "d", "k")


@pytest.fixture(scope="module")
def cat(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("packed"))
    rid = F.col("id")
    fact = spark.range(ROWS).select(
        "id",
        F.when(rid % 3 == 0, 0).otherwise(rid % 1009).alias("g"),
        F.when(rid % 3 == 0, "hot").otherwise(F.concat(F.lit("c"), (rid % 7).cast("string"))).alias("c"),
        F.when(rid % 13 != 0, rid % 11).alias("d"),
        F.when(rid % 50 != 0, (rid * 37 % 1001).cast("double")).alias("x"),
        (rid % 17).cast("double").alias("y"),
        F.lit(None).cast("double").alias("void"),
    )
    fact.repartitionByRange(FILES, "id").sortWithinPartitions("id").write.parquet(f"{folder}/fact.parquet")
    rows = [(i, "odd" if i % 2 else "even", i / 4, i * 10) for i in range(9)]
    spark.createDataFrame(rows, "k bigint, name string, level double, size bigint").coalesce(1).write.parquet(f"{folder}/dim.parquet")
    return Catalog.from_files(spark, SPECS, folder, name="packed")


@pytest.fixture(scope="module")
def index(cat, tmp_path_factory):
    made = BitmapIndex(cat, "fact", str(tmp_path_factory.mktemp("index")))
    made.write()
    return made


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def counts(df):
    return {r[0]: r[1] for r in df.collect()}


def test_ids_follow_files_and_name_no_copy(cat, index):
    rows = index.rows()
    assert "rid" in rows.columns and rows.count() == ROWS == rows.select("rid").distinct().count()
    first = [r["first"] for r in index.files().orderBy("first").collect()]
    assert len(first) == FILES and all((f - 1) % packing.BUCKET_ROWS == 0 for f in first)
    again = index.rows().groupBy("id").agg(F.min("rid").alias("rid"))
    assert again.join(rows.select("id", "rid"), ["id", "rid"]).count() == ROWS
    assert index.fetch(rows.where("id in (5, 70000, 119999)").select("rid")).count() == 3


def test_fetch_reads_only_the_files_that_hold_rows(index):
    wanted = index.rows().where("id in (10, 11, 12)").select("rid").collect()
    spark = index.catalog.spark
    df = index.fetch(spark.createDataFrame([(r["rid"],) for r in wanted], "rid bigint"))
    assert sorted(r["id"] for r in df.collect()) == [10, 11, 12]
    leaves, read = df._jdf.queryExecution().executedPlan().executedPlan().collectLeaves(), []
    for i in range(leaves.size()):
        stack = [leaves.apply(i)]
        while stack:
            node = stack.pop()
            if node.getClass().getSimpleName().endswith("QueryStageExec"):
                inner = node.plan().collectLeaves()
                stack += [inner.apply(j) for j in range(inner.size())]
            elif "fact.parquet" in node.toString() and node.metrics().contains("numFiles"):
                read.append(node.metrics().get("numFiles").get().value())
    assert set(read) == {1}


LITERALS = [-5.0, 0.0, 0.1, 499.9, 500.0, 999.99, 1000.0, 1001.0]


def test_weights_of_bins_are_those_of_the_columns(spark):
    lines = []
    for op, v in itertools.product((">", ">=", "<", "<="), LITERALS):
        first, last = binning.full_bins(op, v, 0.0, 1000.0, 100)
        at, share = binning.boundary_bin(v, 0.0, 1000.0, 100), binning.boundary_fraction(op, v, 0.0, 1000.0, 100)
        lines.append(F.struct(F.lit(op).alias("op"), F.lit(v).alias("v"), first.alias("first"), last.alias("last"), at.alias("at"), share.alias("share")))
    for r in spark.range(1).select(F.inline(F.array(*lines))).collect():
        expected = [1.0 if r["first"] <= b <= r["last"] else r["share"] if b == r["at"] else 0.0 for b in range(100)]
        assert binning.weights_of_bins(r["op"], r["v"], 0.0, 1000.0, 100, True) == expected
    draw = random.Random(1)
    for _ in range(2_000):
        op, v = draw.choice([">", ">=", "<", "<=", "="]), draw.choice(LITERALS + [draw.uniform(-10, 1010)])
        x = draw.choice([v, draw.uniform(0, 1000), 0.0, 1000.0])
        if not 0 <= x <= 1000:
            continue
        sure = binning.certainty_of_bins(op, v, 0.0, 1000.0, 100)[min(int(x / 10.0), 99)]
        holds = {">": x > v, ">=": x >= v, "<": x < v, "<=": x <= v, "=": x == v}[op]
        assert sure == 0.5 or holds == bool(sure), (op, v, x)


def test_any_range_reads_few_containers_a_bucket(index):
    lo, hi = index.catalog.bounds("fact")["x"]
    truth = [r["x"] for r in index.rows().where("x IS NOT NULL").select("x").collect()]
    bins = np.minimum(((np.array(truth) - lo) / ((hi - lo) / 100)).astype(int), 99)
    draw = random.Random(3)
    for first, last in [(0, 99), (0, 0), (99, 99), (9, 10), (10, 19), (37, 41), *[sorted(draw.choices(range(100), k=2)) for _ in range(12)]]:
        weights = [1.0 if first <= b <= last else 0.0 for b in range(100)]
        factor = factors.steps_factor(index.slices("x"), weights)
        most = max(r["n"] for r in factor.containers.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect())
        assert most <= 4
        found = factors.row_set([factor]).agg(F.sum(F.bitmap_count("bitmap"))).first()[0] or 0
        assert found == ((bins >= first) & (bins <= last)).sum(), (first, last)
    shown = plan(factors.steps_factor(index.slices("x"), weights).containers)
    assert "LessThanOrEqual(first" in shown and "GreaterThanOrEqual(last" in shown


def test_one_scan_a_column_and_no_fact_row(cat, index):
    query = AggQuery(
        "COUNT", "x", "fact", "g",
        (Predicate("x", ">", 100.5), Predicate("x", "<=", 700.2), Predicate("y", "<", 9), Predicate("c", "=", "hot")),
    )
    made = groups.bitmap_group_counts(cat, query, index)
    shown = plan(made)
    scans = [line for line in shown.splitlines() if "FileScan parquet" in line]
    assert len(scans) == 4 and not any("fact.parquet" in s for s in scans)
    rows = cat.frame("fact").toPandas()
    weight = np.ones(len(rows))
    for column, op, v in (("x", ">", 100.5), ("x", "<=", 700.2), ("y", "<", 9.0)):
        lo, hi = cat.bounds("fact")[column]
        by_bin = np.array(binning.weights_of_bins(op, v, lo, hi, 100, True))
        x = rows[column].fillna(lo)
        at = np.minimum(((x - lo) / ((hi - lo) / 100)).astype(int), 99)
        weight *= np.where(rows[column].isna(), 0.0, by_bin[at])
    weight *= rows["c"] == "hot"
    expected = weight[weight > 0].groupby(rows["g"]).sum()
    found = counts(made)
    assert found.keys() == set(expected.index) and all(found[g] == pytest.approx(expected[g]) for g in found)


@pytest.mark.parametrize(
    "picked, keep",
    [
        ((), lambda d: True),
        ((Predicate("name", "=", "odd"),), lambda d: d % 2 == 1),
        ((Predicate("name", "=", "even"), Predicate("level", ">=", 0.6)), lambda d: d % 2 == 0 and d / 4 >= 0.6),
        ((Predicate("size", "<", 45), Predicate("k", ">", 1)), lambda d: d * 10 < 45 and d > 1),
        ((Predicate("name", "=", "neither"),), lambda d: False),
    ],
)
def test_join_index(cat, index, picked, keep):
    query = AggQuery("COUNT", "x", "fact", "g", (*picked, Predicate("x", ">", 250.0)), STAR)
    fresh = BitmapIndex(cat, "fact", index.bitmaps_path.split("/index/")[0])
    by_key = counts(groups.predict_groups(cat, query, fresh)) if fresh.joined(STAR) is None else None
    index.write_join(STAR)
    made = groups.predict_groups(cat, query, index)
    shown = plan(made)
    assert "dim.parquet" not in shown and "(column#" in shown and "= d)" not in shown
    found = counts(made)
    rows = cat.frame("fact").toPandas()
    lo, hi = cat.bounds("fact")["x"]
    bins = np.minimum(((rows["x"] - lo) / ((hi - lo) / 100)) // 1, 99)
    there = rows["d"].map(lambda d: d == d and d is not None and d < 9 and keep(d))
    expected = rows[there & (bins > 25 if 250.0 != lo else False)].groupby("g").size().to_dict()
    assert found == expected and by_key in (None, expected)


def test_join_index_wants_unique_keys(spark, cat, tmp_path):
    twice = Catalog(spark, SPECS, {"fact": cat.frame("fact"), "dim": cat.frame("dim").union(cat.frame("dim").limit(1))}, "twice")
    made = BitmapIndex(twice, "fact", str(tmp_path))
    made.write()
    with pytest.raises(ValueError, match="unique"):
        made.write_join(STAR)
    assert made.joined(STAR) is None


def test_topup_takes_the_lowest_draws_of_the_true_candidates(spark, cat, index):
    query = AggQuery("COUNT", "x", "fact", "g", (Predicate("x", ">", 253.0), Predicate("x", "<=", 256.0), Predicate("y", ">=", 16)))
    wider = AggQuery("COUNT", "x", "fact", "g", (Predicate("x", ">", 103.0), Predicate("y", "<", 12.5)))
    rare = spark.createDataFrame([(0, 7), (5, 3), (12, 40), (1008, 1), (99_999, 5), (None, 2)], "grp bigint, need int")
    need = {r["grp"]: r["need"] for r in rare.collect()}
    for asked in (query, wider):
        drawn = groups.topup_from_index(cat, asked, index, rare, 0.1, 42)
        found = {}
        for r in drawn.collect():
            found.setdefault(r["g"], set()).add(r["id"])
        rows = where_all(index.rows(), asked.predicates, index.spec)
        rows = rows.where(~sampling.in_sample(rows, index.spec, 0.1, 42)).select("g", "id", "rid").toPandas()
        rows["draw"] = factors.draws(rows["rid"].to_numpy(), 42)
        expected = {g: set(part.sort_values("draw")["id"][: need[g]]) for g, part in rows.groupby("g") if g in need}
        assert found == expected


def test_rows_in_any_order_pack_alike(spark, cat, index):
    mixed = index.rows().repartition(5)
    one, other = (
        packing.pack_rows(rows, index.spec, cat.bounds("fact"), 100).where("layer = 'values'").groupBy("column", "value", "bucket").agg(F.sum("n").alias("n"))
        for rows in (index.rows(), mixed)
    )
    assert one.exceptAll(other).isEmpty() and other.exceptAll(one).isEmpty()


def test_index_of_an_empty_table(spark, cat, tmp_path):
    none = Catalog(spark, SPECS, {"fact": cat.frame("fact").limit(0), "dim": cat.frame("dim")}, "none")
    made = BitmapIndex(none, "fact", str(tmp_path))
    made.write()
    query = AggQuery("COUNT", "x", "fact", "g", (Predicate("c", "=", "hot"),))
    assert groups.predict_groups(none, query, made).isEmpty()


def test_row_ids_out_of_the_index(cat, index):
    query = AggQuery("COUNT", "x", "fact", "g", (Predicate("x", ">=", 500.0), Predicate("c", "=", "c3")))
    ids = groups.index_row_ids(cat, query, index)
    found = {r["id"] for r in ids.join(index.rows(), "rid").select("id").collect()}
    assert found == {r["id"] for r in where_all(cat.frame("fact"), query.predicates, SPECS["fact"]).select("id").collect()}
