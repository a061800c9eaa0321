"""Declared datasets: table names, column kinds, row counts, index rates."""

from __future__ import annotations

from dataclasses import replace

from thingroups.spec import TableSpec

# The declared schemas, row counts and index rates of the
# flights and store-sales datasets.
FLIGHTS_KINDS = {
    "quarter": "int",
    "month": "int",
    "dayofmonth": "int",
    "dayofweek": "int",
    "reporting_airline": "str",
    "origin": "str",
    "originstatename": "str",
    "dest": "str",
    "deststatename": "str",
    "depdelay": "num",
    "taxiout": "num",
    "arrdelay": "num",
    "taxiin": "num",
    "airtime": "num",
    "distance": "num",
}
FLIGHTS_SIZES = {
    "flights": (6532011, 1.0),
    "flights_20m": (15465984, 1.0),
    "flights_40m": (30931969, 0.5),
    "flights_100m": (77329922, 0.2),
}
STORE_KINDS = {
    "s_store_sk": "int",
    "s_store_name": "str",
    "s_number_employees": "int",
    "s_floor_space": "int",
    "s_gmt_offset": "num",
    "s_tax_percentage": "num",
}
STORE_SALES_KINDS = {
    "ss_store_sk": "int",
    "ss_quantity": "int",
    "ss_wholesale_cost": "num",
    "ss_list_price": "num",
    "ss_sales_price": "num",
}


def flights(size: str = "flights") -> dict[str, TableSpec]:
    rows, rate = FLIGHTS_SIZES[size]
    return {"flights": TableSpec("flights", FLIGHTS_KINDS, ("id",), True, rows, rate)}


def store_sales(rows: int = 2628627, index_rate: float = 1.0) -> dict[str, TableSpec]:
    """The star with one dimension; larger scales differ in rows and rate only.

    The schema declares no unique key, so the locator of a row is built from
    all its columns.
    """
    return {
        "store": TableSpec("store", STORE_KINDS, ("s_store_sk",), False, 12),
        "store_sales": TableSpec(
            "store_sales", STORE_SALES_KINDS, tuple(STORE_SALES_KINDS), True, rows, index_rate
        ),
    }


def testdata() -> dict[str, TableSpec]:
    """The star and event tables used by the checks and the benchmark."""
    return {
        "events": TableSpec(
            "events",
            {"user_id": "int", "event_type": "str", "value": "num"},
            ("event_id",),
            True,
            scales={"value": 2},
        ),
        "orders": TableSpec(
            "orders",
            {"o_custkey": "int", "o_orderstatus": "str", "o_orderpriority": "str", "o_totalprice": "num"},
            ("o_orderkey",),
            True,
            scales={"o_totalprice": 2},
        ),
        "lineitem": TableSpec(
            "lineitem",
            {
                "l_partkey": "int",
                "l_suppkey": "int",
                "l_linenumber": "int",
                "l_returnflag": "str",
                "l_linestatus": "str",
                "l_quantity": "num",
                "l_extendedprice": "num",
                "l_discount": "num",
                "l_tax": "num",
            },
            ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"),
            True,
            scales={"l_quantity": 2, "l_extendedprice": 2, "l_discount": 2, "l_tax": 2},
        ),
        "supplier": TableSpec(
            "supplier",
            {"s_suppkey": "int", "s_nationkey": "int", "s_acctbal": "num"},
            ("s_suppkey",),
            scales={"s_acctbal": 2},
        ),
        "part": TableSpec(
            "part",
            {"p_partkey": "int", "p_brand": "str", "p_type": "str", "p_size": "int", "p_retailprice": "num"},
            ("p_partkey",),
            scales={"p_retailprice": 2},
        ),
        "customer": TableSpec(
            "customer",
            {"c_custkey": "int", "c_nationkey": "int", "c_mktsegment": "str", "c_acctbal": "num"},
            ("c_custkey",),
            scales={"c_acctbal": 2},
        ),
    }


def with_index_rate(specs: dict[str, TableSpec], table: str, rate: float) -> dict[str, TableSpec]:
    return {**specs, table: replace(specs[table], index_rate=rate)}
