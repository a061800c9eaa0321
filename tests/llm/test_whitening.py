"""Whitening against plain exact arithmetic, and its edge cases."""

from fractions import Fraction

import numpy as np
import pytest
from conftest import DATA

from thingroups.llm import whitening
from thingroups.llm.queries import load

SCHEMA = "vec_id long, embedding array<double>, label int, component string, n string, whitened int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", "y", 2) for i, v in rows], SCHEMA)


def plain(rows, components=8):
    """n, deviations, covariance and its leading share, by Python's integers and fractions."""
    kept = [
        (i, v) for i, v in rows
        if v is not None and all(x is not None and np.isfinite(x) and abs(x * 1024) < 2.0**62 for x in v)
    ]
    width = max((len(v) for _, v in kept), default=0)
    x = [[int(np.floor(1024 * float(c))) + 100_000 for c in [*v, *[0.0] * (width - len(v))]] for _, v in kept]
    n = len(x)
    s = [sum(column) for column in zip(*x, strict=True)]
    deviation = [sum((n * a - b) ** 2 for a, b in zip(row, s, strict=True)) for row in x]
    centred = [[Fraction(n * a - b, n) for a, b in zip(row, s, strict=True)] for row in x]
    v = np.array([[float(sum(r[i] * r[j] for r in centred) / n) for j in range(width)] for i in range(width)])
    return [i for i, _ in kept], n, s, deviation, v


def check(found, rows):
    ids, n, s, deviation, v = plain(rows)
    e, vectors = np.linalg.eigh(v)
    e, vectors = e[::-1], vectors[:, ::-1]
    k = min(8, len(s))
    assert len(found) == k * len(ids)
    assert {r["n"] for r in found} == {n}
    exact = sorted((i is None, i or 0, d) for i, d in zip(ids, deviation, strict=True) for _ in range(k))
    assert sorted((r["vec_id"] is None, r["vec_id"] or 0, int(r["deviation_decimal"])) for r in found) == exact
    assert all(r["deviation"] == (int(r["deviation_decimal"]) if r["deviation_decimal"] < 2**63 else None) for r in found)
    for r in found:
        assert r["explained"] == pytest.approx(e[r["component"] - 1] / np.trace(v), rel=1e-9, abs=1e-12)
    return e, vectors


def test_scatter_counts_are_exact():
    draw = np.random.default_rng(1)
    for rows, width, spread in ((1, 3, 10), (63, 4, 2**20), (64, 5, 2), (200, 3, 2**60), (2_500, 6, 1)):
        x = draw.integers(-spread, spread, (rows, width), endpoint=True)
        x[:, 0] = 7  # a dimension without planes
        s, p = whitening.cross_products(x)
        whole = [[int(a) for a in row] for row in x]
        assert s.tolist() == [sum(c) for c in zip(*whole, strict=True)]
        assert p.tolist() == [[sum(r[i] * r[j] for r in whole) for j in range(width)] for i in range(width)]


def test_whitening_edges(spark):
    draw = np.random.default_rng(2)
    rows = [(i, (draw.normal(size=5) * [1, 2, 3, 4, 5] + 50).tolist()) for i in range(3_000)]
    rows += [(1, rows[1][1]), (None, [1.0] * 5), (4_000, []), (4_001, [2.5, 1.0])]
    rows += [(5_000, None), (5_001, [float("nan")] * 5), (5_002, [1.0, None]), (5_003, [float("inf")]), (5_004, [1e300] * 5)]
    found = whitening.report(frame(spark, rows).repartition(7)).collect()
    e, vectors = check(found, rows)
    assert all(r["identity_error"] < 1e-4 for r in found)
    # the same projection up to the sign of each component
    ids, n, s, _, _ = plain(rows)
    mine = {(r["vec_id"], r["component"]): r["whitened"] for r in found if r["vec_id"] not in (None, 1)}
    x = {i: np.floor(1024 * np.array([*v, *[0.0] * (5 - len(v))])) + 100_000 for i, v in rows if i in set(ids) - {None, 1}}
    for c in range(1, 6):
        expected = np.array([(x[i] - np.array(s) / n) @ vectors[:, c - 1] / np.sqrt(e[c - 1]) for i in x])
        got = np.array([mine[i, c] for i in x])
        assert np.allclose(got, expected * np.sign(got @ expected), atol=1e-8)


def test_whitening_of_few_equal_or_no_rows(spark):
    assert whitening.report(frame(spark, [(1, None)])).collect() == []
    same = whitening.report(frame(spark, [(1, [1.0, 2.0])] * 3)).collect()
    assert len(same) == 6 and all(r["whitened"] is None and r["explained"] == 0 and r["identity_error"] is None for r in same)
    flat = whitening.report(frame(spark, [(i, [float(i), 2.0 * i, 5.0]) for i in range(9)])).collect()
    assert [r["whitened"] is None for r in flat if r["vec_id"] == 0] == [False, True, True]
    assert flat[0]["identity_error"] < 1e-9
    huge = [(1, [2.0**51, 0.0]), (2, [-(2.0**51), 1.0]), (3, [3.0, 2.0])]
    found = whitening.report(frame(spark, huge)).collect()
    check(found, huge)
    assert {r["deviation"] for r in found if r["vec_id"] == 1} == {None}


def test_whitening_query(spark):
    found = load()["op12_whitening"][0](spark, DATA).collect()
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    check(found, rows)
    assert found[0]["identity_error"] < 1e-4
