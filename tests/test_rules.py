"""Edge rows of the rules: nulls, NaN, rounding, tolerance, signs."""

from pyspark.sql import functions as F

from ledgerlens.functions import rules
from ledgerlens.functions.values import cents
from ledgerlens.operators import checks, cleaning
from ledgerlens.sources.tables import nan_to_null


def hits(df, rule, id_column="id"):
    return sorted(r[0] for r in df.filter(rule).select(id_column).collect())


def test_null_and_nan_policies(spark):
    df = nan_to_null(
        spark.createDataFrame(
            [(1, 100.0, None, 5.0), (2, 100.0, float("nan"), 5.0), (3, 100.0, 95.0, 5.0)],
            "id int, claimed double, agreed double, residual double",
        )
    )
    c, a, r = F.col("claimed"), F.col("agreed"), F.col("residual")
    assert hits(df, rules.exceeds(a, c)) == []
    assert hits(df, rules.residual_is_off(c, a, r)) == [1, 2]
    assert hits(df, rules.sign_is_plausible(a, F.lit(False))) == [3]


def test_range_and_limit_are_inclusive(spark):
    df = spark.createDataFrame(
        [(1, 0.01), (2, 1.0), (3, 0.009), (4, 1.01), (5, 50000.0), (6, 49999.99), (7, float("nan"))],
        "id int, agreed double",
    )
    assert hits(df, rules.in_range(F.col("agreed"))) == [1, 2]
    assert hits(df, rules.at_least(F.col("agreed"))) == [5]


def test_residual_tolerance_is_exact_for_doubles_and_decimals(spark):
    data = [(1, "10", "4", "5.99"), (2, "10", "4", "5.98"), (3, "10", "4", "6.01")]
    text = spark.createDataFrame(data, "id int, c string, a string, r string")
    for kind in ("double", "decimal(18,2)"):
        df = text.select("id", *[F.col(x).cast(kind).alias(x) for x in "car"])
        rule = rules.residual_is_off(F.col("c"), F.col("a"), F.col("r"))
        assert hits(df, rule) == [2]


def test_cents_round_half_to_even(spark):
    df = spark.createDataFrame([(0.125, 12), (0.375, 38), (-0.125, -12)], "x double, want long")
    assert all(r[0] == r[1] for r in df.select(cents(F.col("x")), "want").collect())
    exact = spark.sql("SELECT CAST('1.005' AS DECIMAL(18,3)) AS x").select(cents(F.col("x")))
    assert exact.first()[0] == 100
    odd = spark.createDataFrame([(float("inf"),), (float("nan"),)], "x double")
    assert [r[0] for r in odd.select(cents(F.col("x"))).collect()] == [None, None]


def test_one_sign_out_of_three(spark):
    df = spark.createDataFrame(
        [(1, -1.0, -1.0, 1.0), (2, 0.0, -1.0, -1.0), (3, -1.0, -1.0, -1.0), (4, None, -1.0, -1.0)],
        "id int, a double, b double, c double",
    )
    odd = rules.odd_sign_out([F.col("a"), F.col("b"), F.col("c")])
    assert [hits(df, o) for o in odd] == [[2, 4], [], [1]]
    summary = {r[0]: r[1] for r in checks.sign_majority_summary(df, ["a", "b", "c"]).collect()}
    assert summary == {"a": 2, "b": 0, "c": 1}
    found = checks.sign_majority_rows(df, ["id"], ["a", "b", "c"]).count()
    assert found == sum(summary.values())


def test_sign_pairs_and_missing_columns(spark):
    df = spark.createDataFrame(
        [(1, -1.0, 1.0, 1.0), (2, 1.0, -1.0, 1.0), (3, 1.0, -1.0, -1.0), (4, 1.0, None, -1.0)],
        "id int, quantity double, ep double, ep_agreed double",
    )
    found = checks.sign_pair_rules(
        df, "quantity", "not_there", [("ep", "ep_agreed"), ("claimed", "agreed")]
    )
    summary = {r[0]: r[1] for r in checks.sign_pair_summary(df, found).collect()}
    assert summary == {"quantity < 0": 1, "sign ep <> ep_agreed": 2}
    listed = checks.sign_pair_rows(df, found, "id", ["quantity", "nope"])
    assert listed.columns == ["id", "quantity"]
    assert sorted(r[0] for r in listed.collect()) == [1, 2, 4]
    generated = checks.sign_pair_rows(df.drop("id"), found, "id", ["ep"])
    assert generated.columns == ["id", "ep"] and generated.count() == 3


def test_sign_pair_summary_is_typed_when_clean(spark):
    df = spark.createDataFrame([(1.0,)], "quantity double")
    none = checks.sign_pair_summary(df, checks.sign_pair_rules(df, "quantity", "x", []))
    assert none.dtypes == [("category", "string"), ("error_count", "bigint")]
    assert none.count() == 0
    no_checks = checks.sign_pair_summary(df, {})
    assert no_checks.dtypes == none.dtypes and no_checks.count() == 0


def test_discount_words_and_plausibility(spark, rows):
    df = spark.createDataFrame(
        [(1, "SKONTO 2%", -5.0), (2, "Skonto", 5.0), (3, None, -5.0), (4, "Rohr", 5.0),
         (5, "Rohr", None)],
        "id int, text string, agreed double",
    )
    done = cleaning.flag_sign_plausibility(cleaning.flag_discounts(df, "text"), "agreed")
    assert rows(done.orderBy("id"), "is_discount", "is_plausible") == [
        (True, True), (True, False), (False, False), (False, True), (False, False)]
    assert checks.implausible_rows(done, "is_plausible", ["id"]).count() == 3
    top = checks.implausible_top(done, "is_plausible", "text")
    assert rows(top) == [("Rohr", 1), ("Skonto", 1)]
    assert checks.implausible_rows(df, "is_plausible", ["id"]).count() == 0


def test_name_match_is_unicode_and_null_safe(spark):
    df = spark.createDataFrame(
        [(1, "KI-Test"), (2, "PROTESTANT"), (3, None), (4, "MÜLLER")], "id int, name string"
    )
    assert hits(df, rules.name_contains(F.col("name"))) == [1, 2]
    assert hits(df, ~rules.name_contains(F.col("name"))) == [3, 4]
    assert hits(df, rules.name_contains(F.col("name"), "müller")) == [4]


def test_overshoot_rows_and_summary(spark, rows):
    df = spark.createDataFrame(
        [(1, 10.0, 12.504), (2, 10.0, 10.004), (3, 5.0, 4.0), (4, None, 4.0)],
        "id int, claimed double, agreed double",
    )
    assert rows(checks.overshoot_rows(df, ["id"], "claimed", "agreed"), "id", "diff") == [(1, 2.5)]
    assert rows(checks.overshoot_summary(df, "claimed", "agreed")) == [(1, 2.5)]
    clean = df.filter("id = 3")
    assert rows(checks.overshoot_summary(clean, "claimed", "agreed")) == [(0, None)]


def test_reconciliation_edge_orders(spark, rows):
    header = spark.createDataFrame(
        [("none0", 0.0, 0.0), ("none5", 5.0, 5.0), ("nulls", 0.0, 0.0), ("ok", 0.3, 0.3),
         ("unknown", None, 0.3), ("off", 3.0, 1.0)],
        "id string, claimed double, agreed double",
    )
    lines = spark.createDataFrame(
        [("nulls", None, None), ("ok", 0.1, 0.1), ("ok", 0.2, 0.2), ("unknown", 0.3, 0.3),
         ("off", 1.0, 1.0), (None, 9.0, 9.0)],
        "id string, claimed double, agreed double",
    )
    totals = checks.line_totals(lines, "id", "claimed", "agreed")
    found = checks.reconciliation_rows(header, totals, "id", "claimed", "agreed", [])
    assert sorted(rows(found), key=str) == [
        ("none5", 5.0, 5.0), ("off", 2.0, 0.0), ("unknown", None, 0.0)]
    missing = checks.headers_without_lines(header, lines, "id")
    assert sorted(r[0] for r in missing.collect()) == ["none0", "none5"]
