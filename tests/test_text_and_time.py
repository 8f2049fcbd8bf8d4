import zlib
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from encoder_helper import trigram_encoder
from ledgerlens.operators import text, timeagg

RULES = [
    ("Malerarbeiten", ["maler", "lack"]),
    ("Elektroarbeiten", ["elektro", "c++"]),
    ("Fahrrad", ["rad"]),
    ("Leer", []),
]


def test_keyword_verdict(spark):
    df = spark.createDataFrame(
        [
            (1, "Maler Müller", "Malerarbeiten"),
            (2, "Maler Müller", "Elektroarbeiten"),
            (3, "Xyz", "Malerarbeiten"),
            (4, None, "Malerarbeiten"),
            (5, "Maler Müller", None),
            (6, "Elektro und Rad", "Fahrrad"),
            (7, "Elektro und Maler", "Fahrrad"),
            (8, "C++ Werkstatt", "Fahrrad"),
        ],
        "id int, company string, trade string",
    )
    verdict = text.keyword_verdict(F.col("company"), F.col("trade"), RULES)
    found = dict(df.select("id", verdict).collect())
    assert found == {
        1: "CONFIRMED_BY_NAME",
        2: "CONFLICT_WITH_MALERARBEITEN",
        3: "NO_KEYWORD_INFO",
        4: "NO_KEYWORD_INFO",
        5: "CONFLICT_WITH_MALERARBEITEN",
        6: "CONFIRMED_BY_NAME",
        7: "CONFLICT_WITH_MALERARBEITEN",
        8: "CONFLICT_WITH_ELEKTROARBEITEN",
    }


def test_rules_from_a_table_keep_their_order(spark):
    table = spark.createDataFrame(
        [(2, "B", ["x"]), (1, "A", ["x", "y"])], "priority int, label string, keywords array<string>"
    )
    df = spark.createDataFrame([("x", "A"), ("x", "C"), ("y", "B")], "company string, trade string")
    found = text.with_keyword_verdict(df, "company", "trade", table).collect()
    verdicts = {(r["company"], r["trade"]): r["check_result"] for r in found}
    assert verdicts == {
        ("x", "A"): "CONFIRMED_BY_NAME",
        ("x", "C"): "CONFLICT_WITH_A",
        ("y", "B"): "CONFLICT_WITH_A",
    }


def test_a_rule_table_equals_a_list_of_rules(spark):
    """Short, empty, null, repeated and mixed-case keywords; null names and trades."""
    rules = [
        (1, "One", ["a"]), (2, "Two", ["AB", "zz", "ab"]), (3, "Three", ["äöü", "%_", "c++"]),
        (4, "Four", []), (5, "Five", ["longer words", None]), (6, "One", ["zz"]), (7, "All", [""]),
    ]
    table = spark.createDataFrame(rules, "priority int, label string, keywords array<string>")
    names = ["A", "xabx", "ÄÖÜ", "50%_", "C++", "some longer words", "longer", "", "zz", None]
    rows = [(n, t, "k") for n in names for t in ["One", "Three", None, "All"]]
    df = spark.createDataFrame(rows, "company string, trade string, priority string")
    listed = [(label, [w for w in words if w is not None]) for _, label, words in rules]
    for some in (table, table.where("label != 'All'"), table.limit(0)):
        kept = {r["priority"] for r in some.collect()}
        own = [rule for rule, (k, *_) in zip(listed, rules) if k in kept]
        want = text.with_keyword_verdict(df, "company", "trade", own).collect()
        found = text.with_keyword_verdict(df, "company", "trade", some).collect()
        assert sorted(map(repr, found)) == sorted(map(repr, want))


def test_twenty_thousand_rules_of_a_table(spark):
    rules = spark.range(20_000).selectExpr(
        "id AS priority", "concat('T', id % 5000) AS label",
        "array(concat('w', id, 'x'), concat('key ', id * 7, ' of')) AS keywords")
    names = spark.range(200_000).selectExpr(
        "concat('Firma W', id * 13 % 60000, 'X und key ', id % 200000, ' of') AS company",
        "concat('T', id % 5000) AS trade")
    found = text.with_keyword_verdict(names, "company", "trade", rules)
    plan = text.rule_labels(names.select("company"), "company", rules)
    assert "ScalarSubquery" not in plan._jdf.queryExecution().optimizedPlan().toString()
    words = [(label, keys) for _, label, keys in map(tuple, rules.collect())]
    part = [r for r in found.collect() if zlib.crc32(r["company"].encode()) % 2000 == 0]
    assert len(part) > 30
    for company, trade, verdict in part:
        hits = [label for label, keys in words if any(w in company.lower() for w in keys)]
        want = f"CONFLICT_WITH_{hits[0]}" if hits else "NO_KEYWORD_INFO"
        assert verdict == ("CONFIRMED_BY_NAME" if trade in hits else want)


def test_many_keyword_rules_compile_and_equal_brute_force(spark):
    rules = [(f"T{i}", [f"w{i}x{k}" for k in range(6)]) for i in range(62)]
    rows = [(f"a w{i}x{i % 6} and W{(7 * i) % 62}x{k} z", f"T{k * 9}") for i in range(62) for k in range(6)]
    df = spark.createDataFrame(rows, "company string, trade string")

    def verdict(name, trade):
        hits = [label for label, words in rules if any(w in name.lower() for w in words)]
        if trade in hits:
            return "CONFIRMED_BY_NAME"
        return f"CONFLICT_WITH_{hits[0]}" if hits else "NO_KEYWORD_INFO"

    found = text.with_keyword_verdict(df, "company", "trade", rules)
    assert {tuple(r) for r in found.collect()} == {(*r, verdict(*r)) for r in rows}


def test_encoding_uses_more_than_one_task(spark):
    names = spark.range(30_000).selectExpr("concat('name ', id) AS n")
    made = text.encode_distinct(names, "n", trigram_encoder(8))
    tasks = made.select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks > 1


def test_ngram_vectors_are_unit_vectors_per_distinct_value(spark):
    df = spark.createDataFrame([("Ab",), ("Ab",), ("",), (None,)], "n string")
    found = {r["value"]: r["vector"] for r in text.ngram_vectors(df, "n").collect()}
    assert set(found) == {"Ab", ""}
    assert sum(x * x for x in found["Ab"]) == pytest.approx(1.0)
    assert sorted(found["Ab"])[-3:] == pytest.approx([3**-0.5] * 3)


def test_association_outliers(spark):
    pairs = (
        [("one", "a")] * 5
        + [("nine", "a")] * 9 + [("nine", "b")]
        + [("eight", "a")] * 8 + [("eight", "b")] * 2
        + [(None, "a"), ("one", None)]
    )
    df = spark.createDataFrame(pairs, "company string, trade string")
    stats = text.association_stats(df, "company", "trade")
    flagged = {(r["company"], r["trade"]) for r in stats.filter("is_outlier").collect()}
    assert flagged == {("nine", "b")}
    sums = stats.groupBy("company").agg(F.sum("ratio").alias("s")).collect()
    assert all(r["s"] == pytest.approx(1) for r in sums)


def test_similarity_threshold_is_strict(spark):
    vectors = spark.createDataFrame(
        [("e", [1.0, 0.0]), ("low", [0.1999, (1 - 0.1999**2) ** 0.5]), ("edge", [0.2, 0.0]),
         ("zero", [0.0, 0.0])],
        "value string, vector array<double>",
    )
    df = spark.createDataFrame(
        [(1, "e", "low"), (2, "e", "edge"), (3, None, "low"), (4, "e", "zero"), (5, "e", "low")],
        "id int, company string, trade string",
    )
    found = text.semantic_mismatches(df, "company", "trade", vectors, vectors).collect()
    assert sorted(r["id"] for r in found) == [1, 5]
    assert found[0]["similarity"] == pytest.approx(0.1999)


def test_encoded_similarity_matches_brute_force(spark):
    names = ["Maler Müller", "Elektro Schmidt", "Malerarbeiten", "Elektroarbeiten", "Dach"]
    rows = [(i, a, b) for i, (a, b) in enumerate((a, b) for a in names for b in names)]
    df = spark.createDataFrame(rows * 3, "id int, company string, trade string")
    encoder = trigram_encoder()
    found = text.semantic_mismatches(
        df, "company", "trade",
        text.encode_distinct(df, "company", encoder, batch_size=2, partitions=3),
        text.encode_distinct(df, "trade", encoder),
        threshold=0.5,
    ).collect()
    scores = encoder(names) @ encoder(names).T
    want = {i for i, a, b in rows if scores[names.index(a), names.index(b)] < 0.5}
    assert {r["id"] for r in found} == want and len(found) == 3 * len(want)
    assert [r["similarity"] for r in found] == sorted(r["similarity"] for r in found)


def test_percent_text(spark):
    df = spark.createDataFrame([(0.1234,), (0.05,)], "ratio double")
    got = [r[0] for r in df.select(text.percent_text(F.col("ratio"))).collect()]
    assert got == ["12.34%", "5.00%"]


def test_growth_compares_observed_months(spark, rows):
    df = spark.createDataFrame(
        [("2024-01", 2.0), ("2024-03", 3.0), ("2024-04", 0.0), ("2024-05", 2.0)],
        "period string, avg_lines double",
    )
    grown = timeagg.with_growth(df, "period", "avg_lines").orderBy("period")
    assert rows(grown, "growth_pct") == [(None,), (50.0,), (-100.0,), (None,)]


def test_lines_per_order_by_month(spark, rows):
    header = spark.createDataFrame(
        [("a", datetime(2024, 1, 31, 23, 59)), ("b", datetime(2024, 1, 1)), ("c", None)],
        "id string, ts timestamp_ntz",
    )
    lines = spark.createDataFrame([("a", 1), ("a", 2), ("a", None), (None, 1)], "id string, n int")
    counts = timeagg.line_counts(lines, "id", "n")
    assert rows(timeagg.lines_per_order_by_month(header, counts, "id", "ts")) == [
        ("2024-01", 1.0, 2, 2, None)]


def trend(spark, values):
    data = [(f"2024-{i + 1:02d}", float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(data, "period string, v double")


def test_trend_highlights(spark, rows):
    found = timeagg.trend_highlights(trend(spark, [2, 1, 3, 3]), "period", "v")
    assert sorted(rows(found)) == [
        ("2024-02", 1.0, "Min"), ("2024-03", 3.0, "Max"), ("2024-04", 3.0, "Last")]
    only = timeagg.trend_highlights(trend(spark, [2]), "period", "v")
    assert rows(only) == [("2024-01", 2.0, "Max")]
    assert rows(timeagg.trend_highlights(trend(spark, [1]).limit(0), "period", "v")) == []


@pytest.mark.parametrize(
    "values, label",
    [([100, 101], "stable"), ([100, 105], "slight rise"), ([100, 95], "slight fall"),
     ([100, 120], "strong rise"), ([100, 50], "strong fall"), ([100], "too short"),
     ([0, 5], "too short"), ([], "too short")],
)
def test_trend_class(spark, values, label):
    df = trend(spark, values) if values else trend(spark, [1]).limit(0)
    assert timeagg.trend_class(df, "period", "v").first()["trend"] == label


def test_incidents_without_timestamp_column(spark):
    df = spark.createDataFrame([(1,)], "id int")
    none = timeagg.monthly_incidents({"x": df}, "ts")
    assert none.count() == 0 and none.columns == ["month", "incidents", "category"]


def test_top_values_break_ties_by_name(spark, rows):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("c",), (None,)], "v string")
    assert rows(timeagg.top_values(df, "v", 2)) == [("c", 2), ("a", 1)]
    assert timeagg.filter_selection(df, "v", []).count() == 5


def test_sparse_similarity_equals_the_dense_one(spark):
    """Same rows and similarities as dense vectors; names without a vector never match."""
    rows = [("Roof Miller", "roofer"), ("Roof Miller", "plumber"), ("xyz", "roofer"), ("", "qq")]
    df = spark.createDataFrame(rows * 3 + [(None, "roofer"), ("a", None)], "company string, trade string")
    df = df.withColumn("id", F.monotonically_increasing_id())
    sides = [text.ngram_vectors(df, c) for c in ("company", "trade")]
    sparse = [text.ngram_weights(df, c) for c in ("company", "trade")]
    dense = text.semantic_mismatches(df, "company", "trade", *sides, threshold=2.0).collect()
    found = text.sparse_mismatches(df, "company", "trade", *sparse, threshold=2.0).collect()
    assert len(found) == 12
    assert {r["id"]: round(r["similarity"], 9) for r in found} == {r["id"]: round(r["similarity"], 9) for r in dense}
    some = sparse[1].where("value <> 'qq'")
    low = text.sparse_mismatches(df, "company", "trade", sparse[0], some, threshold=2.0)
    assert {r["company"] for r in low.collect()} == {"Roof Miller", "xyz"}
    lengths = sparse[0].groupBy("value").agg(F.sum(F.col("weight") * F.col("weight")).alias("n")).collect()
    assert all(abs(r["n"] - 1) < 1e-12 for r in lengths)


def test_names_are_hashed_below_the_first_aggregate(spark):
    df = spark.createDataFrame([("Roof Miller", "roofer")], "company string, trade string")
    sparse = [text.ngram_weights(df, c) for c in ("company", "trade")]
    plan = text.sparse_mismatches(df, "company", "trade", *sparse)._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    hashed = [k for k, line in enumerate(lines) if "md5(" in line]
    assert hashed and all(any("Aggregate [value" in up for up in lines[:k]) for k in hashed)
    assert all("Filter" not in lines[k] and "Join" not in lines[k] for k in hashed)
