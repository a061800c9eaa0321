"""Every registered query against the SQL that must give the same rows."""

import math
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_points
from conftest import DATA
from thingroups.plans.staged import METRIC_TYPES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
    " conversations"
).split()
QUERIES, ORACLES = entry_points.queries(), entry_points.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    return connection


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (int, Decimal)):
        return float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    return str(value)


def lines(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(row[i]) for i in order) for row in rows), key=repr)



@pytest.mark.parametrize("name", QUERIES)
def test_same_rows(name, spark, duck):
    df = QUERIES[name](spark, DATA)
    mine = lines(df.columns, [tuple(r) for r in df.collect()])
    if name not in ORACLES:
        assert df.columns
        return
    answer = duck.execute(ORACLES[name])
    columns = [c[0] for c in answer.description]
    assert sorted(columns) == sorted(df.columns)
    assert mine == lines(columns, answer.fetchall())


def test_queries_without_sql_are_named_by_a_test():
    texts = "".join(p.read_text() for p in Path(__file__).parent.rglob("test_*.py"))
    assert [name for name in QUERIES if name not in ORACLES and name not in texts] == []


def test_metric_row_and_staged_avg_join(spark):
    row = QUERIES["metric_row"](spark, DATA).first().asDict()
    assert list(row) == list(METRIC_TYPES)
    assert row["num_of_rare_groups"] > 0 and row["recall"] == 1 and row["out_rate"] == 0
    assert row["re_after_sampling_rare_groups"] <= row["re_with_samples"] <= 1
    joined = QUERIES["staged_avg_join"](spark, DATA).first().asDict()
    assert joined["precision"] == joined["recall"] == 1 and 0 <= joined["re_after_dynamic_supply"] < 0.5


def test_index_storage_layouts(spark):
    rows = {r["column"]: r for r in QUERIES["index_storage_layouts"](spark, DATA).collect()}
    lineitem = spark.read.parquet(f"{DATA}/lineitem.parquet")
    for column in ("l_partkey", "l_quantity", "l_returnflag"):
        r = rows[column]
        assert r["entries"] == lineitem.where(f"{column} IS NOT NULL").count()
        assert r["adaptive_bytes"] <= min(r["dense_bytes"], r["list_bytes"])


def test_entry(spark):
    rows = entry_points.entry(spark).collect()
    assert len(rows) == 15
    assert sum(r["error"] for r in rows) / 15 == pytest.approx(0.6060, abs=1e-4)
