"""Mergeable profiles against exact figures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import sketches, timeagg


@pytest.fixture(scope="module")
def values():
    random = np.random.default_rng(4)
    return np.round(random.lognormal(3, 1.2, 60_000), 2)


def frame(spark, values, period=None):
    rows = [(i % 12 if period is None else period, float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "period int, amount double")


def test_merged_periods_keep_the_stated_errors(spark, values):
    monthly = sketches.column_sketches(frame(spark, values), ["amount"], {"period": F.col("period")})
    assert monthly.count() == 12
    row = sketches.sketch_profile(sketches.merge_sketches(monthly)).collect()[0]
    assert (row["row_count"], row["count"]) == (len(values), len(values))
    assert (row["min"], row["max"]) == (values.min(), values.max())
    assert row["mean"] == pytest.approx(values.mean())
    exact = len(np.unique(values))
    assert abs(row["distinct_values"] - exact) <= sketches.DISTINCT_ERROR * exact
    for name, q in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75)):
        assert (values < row[name]).mean() <= q + sketches.RANK_ERROR
        assert (values <= row[name]).mean() >= q - sketches.RANK_ERROR


def test_missing_values_and_empty_tables(spark):
    rows = [(1, None, None), (1, float("nan"), None), (2, 0.0, None), (2, -0.0, None), (None, 5.0, None)]
    df = spark.createDataFrame(rows, "k int, `a.b` double, nothing double")
    made = sketches.column_sketches(df, ["a.b", "nothing"], {"k": F.col("k")})
    found = {(r["k"], r["column_name"]): r for r in sketches.sketch_profile(made).collect()}
    assert len(found) == 6
    assert (found[1, "a.b"]["count"], found[1, "a.b"]["p50"], found[1, "a.b"]["distinct_values"]) == (0, None, 0)
    assert (found[2, "a.b"]["count"], found[2, "a.b"]["distinct_values"]) == (2, 1)
    assert found[None, "a.b"]["p50"] == 5.0
    merged = {r["column_name"]: r for r in sketches.sketch_profile(sketches.merge_sketches(made)).collect()}
    assert (merged["a.b"]["row_count"], merged["a.b"]["count"], merged["a.b"]["distinct_values"]) == (5, 3, 2)
    assert (merged["nothing"]["count"], merged["nothing"]["mean"]) == (0, None)
    empty = sketches.column_sketches(df.limit(0), ["nothing"], {"k": F.col("k")})
    assert sketches.sketch_profile(empty).count() == 0


def test_drift_between_two_runs_needs_no_rows(spark, values, tmp_path):
    runs = {"r1": values, "r2": values, "r3": values * 1.5}
    for run, own in runs.items():
        made = sketches.column_sketches(frame(spark, own), ["amount"])
        made.write.parquet(str(tmp_path / run))
    stored = {run: spark.read.parquet(str(tmp_path / run)) for run in runs}
    same = sketches.profile_drift(stored["r2"], stored["r1"]).collect()[0]
    assert (same["null_change"], same["distinct_change"]) == (0.0, 0.0)
    error = 2 * sketches.RANK_ERROR + 1 / sketches.GRID
    assert same["rank_gap"] <= error
    moved = sketches.profile_drift(stored["r3"], stored["r1"]).collect()[0]
    places = np.concatenate([values, values * 1.5])
    ordered = [np.sort(values), np.sort(values * 1.5)]
    ranks = [np.searchsorted(o, places, "right") / len(o) for o in ordered]
    exact = np.abs(ranks[0] - ranks[1]).max()
    assert exact - 1 / 20 - error <= moved["rank_gap"] <= exact + error


def test_a_row_counts_for_every_rule_that_flags_it(spark):
    rows = [("1996-01-05 10:00:00", 5, "a"), ("1996-01-31 00:00:00", 9, "b"), (None, 9, "c"), ("1996-02-01 00:00:00", None, "d")]
    df = spark.createDataFrame(rows, "t string, n int, s string").withColumn("t", F.col("t").cast("timestamp_ntz"))
    tests = {"over 3": F.col("n") > 3, "over 7": F.col("n") > 7, "never": F.lit(False)}
    found = timeagg.monthly_rule_incidents(df, tests, "t").collect()
    assert sorted((r["category"], r["month"].month, r["incidents"]) for r in found) == [("over 3", 1, 2), ("over 7", 1, 1)]
    shown = {"over 3": (tests["over 3"], ["n", "t"]), "over 7": (tests["over 7"], ["s", "t"])}
    out = timeagg.flagged_rows(df, shown, "t", "1996-01-01", "1996-01-31")
    assert out.columns == ["category", "n", "t", "s"]
    assert sorted((r["category"], r["n"], r["s"]) for r in out.collect()) == [("over 3", 5, None), ("over 3", 9, None), ("over 7", None, "b")]
