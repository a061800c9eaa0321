"""Shared pieces of the registered queries: test queries, catalogs, SQL fragments."""

from __future__ import annotations

from collections.abc import Callable
from hashlib import sha1

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thingroups.functions.draws import SPAN
from thingroups.operators.estimate import approx_avg
from thingroups.operators.groups import group_counts
from thingroups.operators.relational import exact, filtered_frames, group_sizes
from thingroups.operators.sampling import sample_frames
from thingroups.sources import datasets
from thingroups.sources.catalog import Catalog
from thingroups.sources.storage import BitmapIndex, scratch_folder
from thingroups.spec import AggQuery, JoinSpec, Predicate

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}


def check(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        REGISTRY[name] = (fn, sql)
        return fn

    return register


# --- catalogs and indexes, one per session and data folder --------------------

_catalogs: dict[tuple, Catalog] = {}
_indexes: dict[tuple, BitmapIndex] = {}


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _catalogs:
        name = f"{spark.sparkContext.applicationId}_{sha1(sf_dir.encode()).hexdigest()[:8]}"
        _catalogs[key] = Catalog.from_files(spark, datasets.testdata(), sf_dir, name=name)
    return _catalogs[key]


def index_of(spark: SparkSession, sf_dir: str, table: str, closed: bool = False) -> BitmapIndex:
    key = (spark.sparkContext.applicationId, sf_dir, table, closed)
    if key not in _indexes:
        index = BitmapIndex(catalog(spark, sf_dir), table, scratch_folder(spark), closed=closed)
        index.write()
        _indexes[key] = index
    return _indexes[key]


def folder(spark: SparkSession, sf_dir: str, purpose: str) -> str:
    return f"{scratch_folder(spark)}/{purpose}/{catalog(spark, sf_dir).name}"


# --- test queries ---------------------------------------------------------------

FLAGSHIP = AggQuery(
    "AVG", "value", "events", "user_id", (Predicate("event_type", "=", "error"), Predicate("value", ">", 20))
)
TAIL = AggQuery("COUNT", "value", "events", "user_id", (Predicate("value", ">", 150),))
ITEMS = AggQuery(
    "SUM",
    "l_extendedprice",
    "lineitem",
    "l_partkey",
    (Predicate("l_returnflag", "=", "R"), Predicate("l_quantity", ">=", 40)),
)
STAR = AggQuery(
    "AVG",
    "l_quantity",
    "lineitem",
    "l_returnflag",
    (Predicate("s_nationkey", "=", 3), Predicate("l_discount", ">=", 0.05)),
    JoinSpec("supplier", "l_suppkey", "s_suppkey"),
)
STAR_COUNT = AggQuery(
    "COUNT",
    "l_quantity",
    "lineitem",
    "l_suppkey",
    (Predicate("s_acctbal", ">", 0), Predicate("l_extendedprice", "<", 20000)),
    JoinSpec("supplier", "l_suppkey", "s_suppkey"),
)
PRIORITIES = AggQuery("COUNT", "o_totalprice", "orders", "o_orderpriority")

RATE = 0.1


def sampled(cat: Catalog, query: AggQuery, rate: float = RATE) -> dict[str, DataFrame]:
    """Sample frames with the query's predicates applied."""
    return filtered_frames(cat, query, sample_frames(cat, cat.tables_of(query), rate))


def truth_and_sample(cat: Catalog) -> tuple[DataFrame, DataFrame]:
    """Exact flagship answer and its sampled estimate."""
    return exact(cat, FLAGSHIP), approx_avg(cat, FLAGSHIP, sampled(cat, FLAGSHIP))


def truth_and_tail(cat: Catalog) -> tuple[DataFrame, DataFrame]:
    """Exact tail counts and the index estimate, which has groups the truth lacks."""
    estimate = group_counts(cat, TAIL).select("grp", F.col("est_count").alias("value"))
    return exact(cat, TAIL), estimate


def predicted_and_sizes(cat: Catalog, query: AggQuery = FLAGSHIP) -> tuple[DataFrame, DataFrame]:
    return group_counts(cat, query), group_sizes(sampled(cat, query)[query.table], query.group)


# --- SQL fragments ----------------------------------------------------------------

FLAG_WHERE = "event_type = 'error' AND value > 20"
ITEM_WHERE = "l_returnflag = 'R' AND l_quantity >= 40"
STAR_FROM = (
    "lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey = 3 AND l_discount >= 0.05"
)
STAR_COUNT_FROM = (
    "lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_acctbal > 0 AND l_extendedprice < 20000"
)
ITEM_KEY = (
    "concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey,"
    " CAST(l_extendedprice AS DECIMAL(18,2)), l_shipdate)"
)


def h(salt: str, key: str) -> str:
    return f"md5(concat_ws('|', '{salt}', {key}))"


def u(salt: str, key: str) -> str:
    return f"(('0x' || substr({h(salt, key)}, 1, 8))::BIGINT / 4294967296::DOUBLE)"


def u_fine(salt: str, key: str) -> str:
    return f"(('0x' || substr({h(salt, key)}, 1, 13))::BIGINT / 4503599627370496::DOUBLE)"


def u_open(salt: str, key: str) -> str:
    return f"((('0x' || substr({h(salt, key)}, 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)"


def keep(rate: float, salt: str, key: str) -> str:
    return f"(substr({h(salt, key)}, 1, 8) < '{int(rate * SPAN):08x}')"


def total(x: str) -> str:
    return f"CAST(SUM(CAST({x} AS DECIMAL(18,2))) AS DOUBLE)"


def mean(x: str) -> str:
    return f"({total(x)} / COUNT({x}))"


IN_SAMPLE = keep(RATE, "u1|42", "event_id")
ITEM_IN_SAMPLE = keep(RATE, "u1|42", ITEM_KEY)

TRUTH = f"SELECT user_id AS grp, {mean('value')} AS value FROM events WHERE {FLAG_WHERE} GROUP BY 1"
ESTIMATE = (
    f"SELECT user_id AS grp, {mean('value')} AS value FROM events WHERE {FLAG_WHERE} AND {IN_SAMPLE} GROUP BY 1"
)


def bounds(table: str, column: str, name: str = "b") -> str:
    """CTE with lo, hi and bin width of a column."""
    return (
        f"{name} AS (SELECT lo, hi, (hi - lo) / 100 AS w FROM"
        f" (SELECT min({column})::DOUBLE AS lo, max({column})::DOUBLE AS hi FROM {table}))"
    )


def bin_of(x: str, b: str = "b") -> str:
    return f"CAST(least(floor(({x} - {b}.lo) / {b}.w), 99) AS INTEGER)"


def at(v: float, b: str = "b") -> str:
    return (
        f"(CASE WHEN {v} < {b}.lo THEN -1 WHEN {v} >= {b}.hi THEN 100"
        f" ELSE CAST(floor(({v}::DOUBLE - {b}.lo) / {b}.w) AS INTEGER) END)"
    )


def share(op: str, v: float, b: str = "b") -> str:
    left = f"({b}.lo + {b}.w * {at(v, b)})"
    raw = f"(({left} + {b}.w) - {v}::DOUBLE)" if op in (">", ">=") else f"({v}::DOUBLE - {left})"
    return f"least(greatest({raw} / {b}.w, 0.0::DOUBLE), 1.0::DOUBLE)"


def weight(x: str, op: str, v: float, b: str = "b") -> str:
    side = ">" if op in (">", ">=") else "<"
    closed = f" WHEN {x} = {v} THEN 1.0::DOUBLE" if op in (">=", "<=") else ""
    return (
        f"(CASE{closed} WHEN {bin_of(x, b)} {side} {at(v, b)} THEN 1.0::DOUBLE"
        f" WHEN {bin_of(x, b)} = {at(v, b)} THEN {share(op, v, b)} ELSE 0.0::DOUBLE END)"
    )


# Estimated group sizes of the test queries, to be used as CTEs.
FLAG_COUNTS = (
    f"{bounds('events', 'value')}, counts AS (SELECT grp, est_count FROM (SELECT user_id AS grp,"
    f" SUM({weight('value', '>', 20)}) AS est_count FROM events, b WHERE event_type = 'error' GROUP BY 1)"
    " WHERE est_count > 0)"
)
TAIL_COUNTS = (
    f"{bounds('events', 'value')}, counts AS (SELECT grp, est_count FROM (SELECT user_id AS grp,"
    f" SUM({weight('value', '>', 150)}) AS est_count FROM events, b GROUP BY 1) WHERE est_count > 0)"
)
TAIL_TRUTH = "SELECT user_id AS grp, COUNT(value)::DOUBLE AS value FROM events WHERE value > 150 GROUP BY 1"
ITEM_COUNTS = (
    f"{bounds('lineitem', 'l_quantity')}, counts AS (SELECT grp, est_count FROM (SELECT l_partkey AS grp,"
    f" SUM({weight('l_quantity', '>=', 40)}) AS est_count FROM lineitem, b WHERE l_returnflag = 'R' GROUP BY 1)"
    " WHERE est_count > 0)"
)
