import pytest
from pyspark.sql import functions as F

from thingroups.functions import binning


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_half_open_bins(spark):
    rows = spark.createDataFrame([(x,) for x in (0.0, 0.5, 1.0, 1.5, 99.5, 100.0)], "x double")
    found = [r["b"] for r in rows.select("x", binning.bin_of(F.col("x"), 0, 100, 100).alias("b")).orderBy("x").collect()]
    assert found == [0, 0, 1, 1, 99, 99]


def test_closed_bins_share_edges(spark):
    rows = spark.createDataFrame([(x,) for x in (0.0, 0.5, 1.0, 99.0, 100.0)], "x double")
    found = [r["b"] for r in rows.select("x", binning.bins_touched(F.col("x"), 0, 100, 100).alias("b")).orderBy("x").collect()]
    assert found == [[0], [0], [0, 1], [98, 99], [99]]


def test_null_and_constant(spark):
    rows = spark.createDataFrame([(None,), (5.0,)], "x double")
    found = rows.select(binning.bin_of(F.col("x"), 5, 5, 100).alias("b"), binning.bins_touched(F.col("x"), 5, 5, 100).alias("t"))
    assert [tuple(r) for r in found.collect()] == [(None, None), (0, [0])]
    for op, v, weight in ((">=", 5.0, 1.0), (">", 5.0, 0.0), ("<=", 5.0, 1.0), ("<", 5.0, 0.0), (">", 4.0, 1.0)):
        assert one(spark, binning.range_weight(F.lit(5.0), op, v, 5.0, 5.0, 100)) == weight


@pytest.mark.parametrize(
    "op, v, at, share, full",
    [
        (">", 20.25, 20, 0.75, (21, 99)),
        (">=", 20.25, 20, 0.75, (21, 99)),
        ("<", 20.25, 20, 0.25, (0, 19)),
        ("<=", 20.25, 20, 0.25, (0, 19)),
        (">", 200, 100, 0.0, (101, 99)),
        ("<", -5, -1, 0.0, (0, -2)),
        (">", -5, -1, 1.0, (0, 99)),
        ("<", 200, 100, 1.0, (0, 99)),
    ],
)
def test_locating_a_literal(spark, op, v, at, share, full):
    assert one(spark, binning.boundary_bin(v, 0, 100, 100)) == at
    assert one(spark, binning.boundary_fraction(op, v, 0, 100, 100)) == pytest.approx(share)
    assert tuple(one(spark, c) for c in binning.full_bins(op, v, 0, 100, 100)) == full
