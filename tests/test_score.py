import pytest

from thingroups.operators.score import group_errors, lost_groups, out_groups, score, true_negatives


def frame(spark, rows):
    return spark.createDataFrame(rows, "grp string, value double")


def scored(spark, truth, estimate):
    return score(frame(spark, truth), frame(spark, estimate)).first()


def test_both_empty(spark):
    row = scored(spark, [], [])
    assert (row["missing_rate"], row["out_rate"]) == (0.0, 0.0)
    assert (row["relative_error"], row["precision"], row["recall"]) == (1.0, 1.0, 0.0)


def test_empty_estimate(spark):
    row = scored(spark, [("a", 1.0)], [])
    assert (row["relative_error"], row["precision"], row["recall"]) == (1.0, 1.0, 0.0)
    assert (row["missing_rate"], row["out_rate"]) == (1.0, 0.0)


def test_one_match_one_lost_one_extra(spark):
    truth, estimate = [("a", 10.0), ("b", 5.0)], [("a", 8.0), ("c", 1.0)]
    row = scored(spark, truth, estimate)
    assert row["relative_error"] == pytest.approx(0.7333, abs=1e-4)
    assert [row[c] for c in ("precision", "recall", "missing_rate", "out_rate")] == [0.5] * 4
    t, e = frame(spark, truth), frame(spark, estimate)
    assert {r["grp"]: round(r["error"], 6) for r in group_errors(t, e).collect()} == {"a": 0.2, "b": 1.0, "c": 1.0}
    assert [r["grp"] for r in lost_groups(t, e).collect()] == ["b"]
    assert [r["grp"] for r in out_groups(t, e).collect()] == ["c"]
    domain = spark.createDataFrame([(g,) for g in "abcd"], "grp string")
    assert [r["grp"] for r in true_negatives(domain, t, e).collect()] == ["d"]


def test_error_is_capped(spark):
    assert scored(spark, [("a", 1.0)], [("a", 9.0)])["relative_error"] == 1.0


def test_null_group_and_null_truth(spark):
    row = scored(spark, [(None, 4.0), ("a", None)], [(None, 4.0), ("a", 2.0)])
    assert row["tp"] == 2 and row["relative_error"] == pytest.approx(0.5)


def test_empty_truth(spark):
    row = scored(spark, [], [("a", 1.0)])
    assert (row["relative_error"], row["precision"], row["recall"], row["out_rate"]) == (1.0, 0.0, 0.0, 0.0)
