"""Quantiles and drift against brute force, with and without buckets."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import distribution, drift, profile
from ledgerlens.operators.drift import DriftRoles

BUCKETED = {"buckets": 7}


@pytest.fixture(scope="module")
def skewed():
    """A third of all rows in one group, many copies of one value, nulls."""
    random = np.random.default_rng(7)
    group = np.where(random.random(3000) < 0.35, "hot", random.choice(list("abcdef"), 3000))
    value = np.round(random.lognormal(3, 2, 3000), 2)
    value[random.random(3000) < 0.3] = 12.5
    frame = pd.DataFrame({"id": range(3000), "g": group, "v": value})
    frame.loc[frame.index % 50 == 0, "g"] = None
    frame.loc[frame.index % 70 == 0, "v"] = None
    return frame


@pytest.mark.parametrize("options", [{}, BUCKETED])
def test_group_quantiles_match_numpy(spark, skewed, options):
    df = spark.createDataFrame(skewed).replace(float("nan"), None)
    qs = [0.0, 0.01, 0.25, 0.5, 0.95, 1.0]
    found = distribution.group_quantiles(df, ["g"], "v", qs, **options).collect()
    kept = skewed.dropna()
    assert len(found) == kept["g"].nunique()
    for row in found:
        expected = np.quantile(kept.loc[kept["g"] == row["g"], "v"], qs)
        assert np.allclose([row[f"q{i}"] for i in range(len(qs))], expected, rtol=1e-12)


@pytest.mark.parametrize("options", [{}, BUCKETED])
def test_whole_table_quantile_and_empty_table(spark, skewed, options):
    df = spark.createDataFrame(skewed).replace(float("nan"), None)
    got = distribution.quantile_value(df, "v", 0.95, "p", **options).first()[0]
    assert got == pytest.approx(np.nanquantile(skewed["v"], 0.95), rel=1e-12)
    assert distribution.quantile_value(df.limit(0), "v", 0.95, "p", **options).first()[0] == 0


@pytest.mark.parametrize("options", [{}, BUCKETED])
def test_outliers_match_pandas(spark, skewed, options):
    df = spark.createDataFrame(skewed).replace(float("nan"), None)
    found = distribution.group_outliers(df, "g", "v", 0.9, **options)
    assert found.columns == ["id", "g", "v"]
    kept = skewed.dropna()
    by_group = kept.groupby("g")["v"]
    out = (kept["v"] > by_group.transform(lambda x: np.quantile(x, 0.9))) | (
        kept["v"] < by_group.transform(lambda x: np.quantile(x, 0.1))
    )
    assert sorted(r["id"] for r in found.collect()) == sorted(kept.loc[out, "id"])
    mirrored = distribution.group_outliers(df, "g", "v", 0.1, **options)
    assert mirrored.count() == found.count()


def test_result_does_not_depend_on_the_ranges(spark, skewed):
    """Any number of ranges, more than there are values included: same quantiles."""
    df = spark.createDataFrame(skewed).replace(float("nan"), None)
    qs = [0.01, 0.5, 0.99]
    plain = distribution.group_quantiles(df, ["g"], "v", qs).collect()
    for parts in (1, 5, 300):
        cut = distribution.group_quantiles(df, ["g"], "v", qs, buckets=parts)
        assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, plain))


def test_cells_are_as_many_as_groups_and_ranges(spark, skewed):
    """Offsets stay small whatever the table, and a frequent value is one row."""
    df = spark.createDataFrame(skewed).replace(float("nan"), None).dropna()
    placed = distribution.ordered_counts(df, ["g"], "v", [F.count(F.lit(1)).alias("_n")], 9)
    cells = placed.select("g", "_part").distinct().count()
    assert cells <= df.select("g").distinct().count() + 9
    assert placed.count() == df.select("g", "v").distinct().count()
    assert placed.agg(F.sum("_n")).first()[0] == df.count()


def test_histogram_keeps_every_value_below_the_limit(spark):
    df = spark.createDataFrame([(float(i),) for i in range(101)], "diff double")
    p95 = distribution.quantile_value(df, "diff", 0.95, "p95")
    found = distribution.histogram(df, "diff", p95).collect()
    assert sum(r["occurrences"] for r in found) == 101 and len(found) == 10
    same = spark.createDataFrame([(3.0,), (3.0,)], "diff double")
    one = distribution.histogram(same, "diff", distribution.quantile_value(same, "diff", 0.95, "p"))
    assert [(r["bin"], r["occurrences"]) for r in one.collect()] == [(0, 2)]
    top = distribution.extreme_rows(df, "diff", p95, [], 3)
    assert [r[0] for r in top.collect()] == [100.0, 99.0, 98.0]


def test_profile_matches_pandas(spark, skewed):
    df = spark.createDataFrame(skewed[["v"]]).replace(float("nan"), None)
    row = profile.numeric_profile(df, ["v"], buckets=64).first()
    want = skewed["v"].describe()
    names = {"count": "count", "mean": "mean", "std": "std", "min": "min", "p25": "25%",
             "p50": "50%", "p75": "75%", "max": "max"}
    for mine, theirs in names.items():
        assert row[mine] == pytest.approx(want[theirs], rel=1e-9)


START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def dated():
    random = np.random.default_rng(3)
    n = 4000
    day = random.integers(0, 40, n)
    return pd.DataFrame(
        {
            "ts": [START + timedelta(days=int(d)) for d in day],
            "x": np.round(random.normal(0, 5, n) + day / 10, 1),
            "y": np.where(random.random(n) < 0.4, 1.0, random.exponential(2, n)),
            "c": np.where(random.random(n) < 0.33, "hot", random.choice(list("uvw"), n)),
        }
    )


ROLES = DriftRoles("ts", ["x", "y"], ["c"])
REF, CUR = ("2024-01-01", "2024-01-21"), ("2024-01-15", "2024-02-09")  # they overlap


def slices(dated):
    def cut(days):
        first, last = [pd.Timestamp(d) for d in days]
        return dated[(dated["ts"] >= first) & (dated["ts"] < last)]

    return cut(REF), cut(CUR)


def brute_w1(a, b):
    points = np.sort(np.concatenate([a, b]))
    f = np.searchsorted(np.sort(a), points[:-1], side="right") / len(a)
    g = np.searchsorted(np.sort(b), points[:-1], side="right") / len(b)
    return float(np.sum(np.abs(f - g) * np.diff(points)))


def with_ts(spark, dated):
    df = spark.createDataFrame(dated)
    return df.withColumn("ts", df.ts.cast("timestamp_ntz"))


@pytest.mark.parametrize("options", [{}, BUCKETED])
@pytest.mark.parametrize("normed", [False, True])
def test_wasserstein_matches_brute_force(spark, dated, options, normed):
    ref, cur = slices(dated)
    found = drift.wasserstein(with_ts(spark, dated), ROLES, REF, CUR, normed, **options)
    got = {r["column_name"]: r["distance"] for r in found.collect()}
    for name in ("x", "y"):
        want = brute_w1(ref[name].to_numpy(), cur[name].to_numpy())
        want /= np.std(ref[name]) if normed else 1
        assert got[name] == pytest.approx(want, rel=1e-9)


def test_jensen_shannon_bounds_symmetry_and_value(spark, dated):
    df = with_ts(spark, dated)
    there = drift.jensen_shannon(df, ROLES, REF, CUR).first()["distance"]
    back = drift.jensen_shannon(df, ROLES, CUR, REF).first()["distance"]
    assert there == pytest.approx(back) and 0 <= there <= 1
    ref, cur = slices(dated)
    p = ref["c"].value_counts(normalize=True)
    q = cur["c"].value_counts(normalize=True).reindex(p.index)
    m = (p + q) / 2
    want = np.sqrt(((p * np.log2(p / m)).sum() + (q * np.log2(q / m)).sum()) / 2)
    assert there == pytest.approx(want)


def test_drift_of_a_slice_with_itself_is_zero(spark, dated):
    report = drift.drift_report(with_ts(spark, dated), ROLES, REF, REF)
    assert {r["column_name"]: r["distance"] for r in report.collect()} == {
        "x": 0.0, "y": 0.0, "c": 0.0, "(dataset)": 0.0}
    assert not any(r["drifted"] for r in report.collect())


def test_drift_with_an_empty_slice_is_unknown(spark, dated):
    empty = ("2020-01-01", "2020-02-01")
    report = drift.drift_report(with_ts(spark, dated), ROLES, empty, CUR)
    assert all(r["distance"] is None for r in report.filter("kind <> 'dataset'").collect())


def test_drift_thresholds(spark, dated):
    report = drift.drift_report(
        with_ts(spark, dated), ROLES, REF, CUR, threshold=1000, thresholds={"x": 1e-9}
    )
    flags = {r["column_name"]: r["drifted"] for r in report.collect()}
    assert flags["x"] and not flags["y"] and not flags["c"] and not flags["(dataset)"]


def test_slice_end_is_exclusive_and_bounds_are_swapped(spark, dated):
    df = with_ts(spark, dated)
    want = len(slices(dated)[0])
    assert drift.date_slice(df, "ts", *REF).count() == want
    assert drift.date_slice(df, "ts", REF[1], REF[0]).count() == want
    assert drift.ordered(datetime(2024, 2, 1, 13), "2024-01-01") == ("2024-01-01", "2024-02-01")
