from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import cleaning, completeness, uniqueness
from ledgerlens.sources.tables import read_table, write_table


def test_placeholders_match_whole_values_only(spark, rows):
    df = spark.createDataFrame(
        [("-", 1), (" - ", 2), ("(leer)", 3), ("(LEER)", 4), (None, 5)], "a string, n int"
    )
    found = rows(cleaning.placeholders_to_null(df).orderBy("n"), "a")
    assert found == [(None,), (" - ",), (None,), ("(LEER)",), (None,)]


def test_corrections_match_whole_values_only(spark, rows):
    df = spark.createDataFrame([("Kfz", 1), ("Kfz Schaden", 2)], "a string, n int")
    assert rows(cleaning.correct_values(df).orderBy("n"), "a") == [("KFZ",), ("Kfz Schaden",)]


def test_nan_is_null_after_load(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan")), (2, 1.25)], "id int, x double")
    write_table(df, str(tmp_path / "t"))
    assert read_table(spark, str(tmp_path / "t")).filter("x IS NULL").count() == 1
    exact = read_table(spark, str(tmp_path / "t"), money=["x"])
    assert dict(exact.dtypes)["x"] == "decimal(18,2)"


def test_time_table_fan_out_and_dedupe(spark, rows):
    header = spark.createDataFrame([("a", "n1"), ("b", "n2"), ("c", "n3")], "id string, no string")
    early, late = datetime(2024, 1, 1), datetime(2024, 2, 1)
    times = spark.createDataFrame(
        [("a", "x", late), ("a", "x", early), ("b", "x", None)],
        "id string, no string, ts timestamp_ntz",
    )
    assert cleaning.attach_timestamps(header, times, "id").count() == 4
    one = cleaning.attach_timestamps(header, times, "id", dedupe_on="ts")
    assert one.columns == ["id", "no", "ts"]
    assert rows(one.orderBy("id")) == [("a", "n1", early), ("b", "n2", None), ("c", "n3", None)]


def test_line_count_is_null_without_lines(spark, rows):
    header = spark.createDataFrame([("a",), ("b",)], "id string")
    counts = spark.createDataFrame([("a", 3)], "id string, line_count long")
    done = cleaning.attach_line_count(header, counts, "id")
    assert dict(done.dtypes)["line_count"] == "int"
    assert rows(done.orderBy("id")) == [("a", 3), ("b", None)]


def test_times_and_count_in_one_shuffle_of_the_header(spark, rows):
    header = spark.createDataFrame(
        [("a", "n1"), ("a", "n2"), ("b", "n3"), ("c", "n4"), ("d", "n5"), (None, "n6")], "id string, no string"
    )
    early, late = datetime(2024, 1, 1), datetime(2024, 2, 1)
    times = spark.createDataFrame(
        [("a", "x", late), ("a", "x", early), ("b", "x", None), (None, "x", late), ("z", "x", late)],
        "id string, no string, ts timestamp_ntz",
    )
    counts = spark.createDataFrame([("a", 3), ("c", 2), ("y", 1)], "id string, line_count long")
    for dedupe in (None, "ts"):
        stepwise = cleaning.attach_line_count(cleaning.attach_timestamps(header, times, "id", dedupe), counts, "id")
        at_once = cleaning.attach_times_and_count(header, times, counts, "id", "line_count", dedupe)
        assert at_once.dtypes == stepwise.dtypes
        assert sorted(map(repr, rows(at_once))) == sorted(map(repr, rows(stepwise)))
        joins = [d._jdf.queryExecution().optimizedPlan().toString().count("LeftOuter") for d in (stepwise, at_once)]
        assert joins == [2, 1]  # joins that the header is shuffled for


def test_narrowing(spark):
    df = spark.createDataFrame(
        [(1, 200, 70000, 2**40, 0.12345678, 0.5), (2, -5, 0, 0, 0.98765432, 0.25)],
        "a long, b long, c long, d long, x double, y double",
    )
    ints = dict(cleaning.narrow_integers(df).dtypes)
    assert [ints[c] for c in "abcd"] == ["tinyint", "smallint", "int", "bigint"]
    floats = dict(cleaning.narrow_floats(df).dtypes)
    assert floats["y"] == "float"


def test_lenient_timestamps(spark, rows):
    df = spark.createDataFrame([("2024-01-02 03:04:05",), ("not a date",), (None,)], "ts string")
    assert rows(cleaning.parse_timestamps(df, "ts")) == [(datetime(2024, 1, 2, 3, 4, 5),)]
    assert cleaning.parse_timestamps(df, "ts", drop_invalid=False).count() == 3


def test_null_ratios(spark, rows):
    df = spark.createDataFrame(
        [(1, None, "g"), (2, "x", "g"), (3, "x", None)], "id int, a string, grp string"
    )
    found = dict(rows(completeness.null_ratio_by_column(df)))
    assert found == {"id": 0.0, "a": 33.33, "grp": 33.33}
    assert rows(completeness.null_row_ratio(df, ["grp", "unknown"])) == [(1 / 3 * 100,)]
    assert rows(completeness.null_row_ratio(df.limit(0))) == [(0.0,)]
    assert rows(completeness.grouped_null_row_ratio(df, "grp")) == [("g", 0.5)]
    assert rows(completeness.grouped_null_ratio(df, "grp", only="none")) == []


def test_error_frequency_order_and_empty_columns(spark, rows):
    df = spark.createDataFrame(
        [(1, datetime(2024, 1, 7, 5), None), (2, datetime(2024, 1, 1, 5), "x"), (3, None, None)],
        "id int, ts timestamp_ntz, a string",
    )
    assert rows(completeness.error_frequency(df, "ts", "id")) == [
        ("Monday", 5, 1, 0, 0.0), ("Sunday", 5, 1, 1, 100.0)]
    with pytest.raises(ValueError):
        completeness.error_frequency(df.select("id", "ts"), "ts", "id")


def test_uniqueness_and_nulls(spark, rows):
    df = spark.createDataFrame(
        [(1, "n", None), (1, "n", None), (1, None, "u"), (1, None, "v")],
        "country int, no string, id string",
    )
    assert rows(uniqueness.uniqueness(df, "id"), "is_unique") == [(False,)]
    pair = uniqueness.uniqueness(df, ["country", "no"], drop_null_keys=True)
    assert rows(pair) == [(False, 1, 2)]
    assert uniqueness.duplicate_rows(df, ["country", "no"]).count() == 2
    assert rows(uniqueness.uniqueness(df.limit(0), "id"))[0][0] is True


def test_id_format(spark, rows):
    good = "12345678-1234-1234-1234-123456789012"
    df = spark.createDataFrame(
        [(good,), ("1234567-12345-1234-1234-123456789012",), ("short",), (None,)], "id string"
    )
    found = {r["id"]: r for r in uniqueness.id_format_violations(df, "id").collect()}
    assert set(found) == {"1234567-12345-1234-1234-123456789012", "short"}
    moved = found["1234567-12345-1234-1234-123456789012"]
    assert not moved["bad_length"] and moved["bad_segment_0"] and moved["bad_segment_1"]
    assert found["short"]["bad_segment_4"]
    counts = uniqueness.segment_value_counts(df, "id")
    assert counts.filter("position = 2 AND value = '1234'").first()["occurrences"] == 2


def test_labels_become_text(spark):
    df = spark.createDataFrame([(1, "a")], "n int, s string")
    assert cleaning.as_strings(df, ["n"]).dtypes == [("n", "string"), ("s", "string")]
    assert df.filter(F.col("n") == 1).count() == 1
