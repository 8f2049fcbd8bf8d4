"""Joins of keys whose types differ between the two sides."""

import pytest

from ledgerlens.operators import checks, cleaning
from ledgerlens.operators.joins import attach, measured_broadcasts
from ledgerlens.plans import batch, claims


@pytest.mark.parametrize(
    "left, right",
    [("bigint", "int"), ("smallint", "bigint"), ("decimal(12,4)", "decimal(10,2)"), ("double", "int")],
)
def test_attach_casts_keys_to_a_common_type(spark, left, right):
    a = spark.range(5).selectExpr(f"CAST(id AS {left}) AS k", "id AS x")
    b = spark.range(5).selectExpr(f"CAST(id AS {right}) AS k", "id * 10 AS y")
    assert sorted(tuple(r)[1:] for r in attach(a, b, "k").collect()) == [(i, i * 10) for i in range(5)]
    assert attach(a, b, "k", "left_anti").count() == 0


def test_attach_refuses_text_against_numbers(spark):
    a, b = spark.range(2).selectExpr("CAST(id AS string) AS k"), spark.range(2).selectExpr("id AS k")
    with pytest.raises(TypeError):
        attach(a, b, "k")


def test_narrowed_header_finds_its_lines(spark):
    header = spark.range(4).selectExpr("id AS k", "10D AS claimed", "10D AS agreed")
    lines = spark.range(4).selectExpr("id AS k", "id AS n", "10D AS claimed", "10D AS agreed")
    narrow = cleaning.narrow_integers(header)
    assert dict(narrow.dtypes)["k"] == "tinyint"
    totals = checks.line_totals(lines, "k", "claimed", "agreed")
    assert checks.reconciliation_rows(narrow, totals, "k", "claimed", "agreed", []).count() == 0
    assert checks.headers_without_lines(narrow, lines, "k").count() == 0


def test_line_count_beyond_a_short(spark):
    lines = spark.range(40_000).selectExpr("1L AS k")
    counts = lines.groupBy("k").count().withColumnRenamed("count", "line_count")
    found = cleaning.attach_line_count(spark.range(1, 2).selectExpr("id AS k"), counts, "k")
    assert found.first()["line_count"] == 40_000


def test_broadcast_by_measured_size_only(spark, tmp_path):
    """Stored rows that compress well are no small side; one that a shuffle has shown small is."""
    static, adaptive = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    before = [spark.conf.get(n, None) for n in (static, adaptive)]
    path = str(tmp_path / "side")
    spark.range(20_000).selectExpr("id AS k", "repeat('x', 500) AS text").write.parquet(path)
    spark.conf.set(static, "1000000")
    try:
        rows = spark.range(100_000).selectExpr("id % 1000 AS k")
        side = spark.read.parquet(path)
        with measured_broadcasts(spark):
            for limit, wanted in ((20_000, False), (10, True)):
                joined = rows.join(side.filter(f"k % 20000 < {limit}"), "k", "left")
                assert joined.filter("text IS NULL").count() == (0 if limit > 1000 else 99_000)
                joined.collect()
                plan = joined._jdf.queryExecution().executedPlan().toString()
                final = plan[: plan.find("Initial Plan")]
                assert ("BroadcastHashJoin" in final) == wanted
                assert "BroadcastHashJoin" not in plan[plan.find("Initial Plan"):]
            with pytest.raises(ValueError), measured_broadcasts(spark):
                raise ValueError
            assert spark.conf.get(static) == "-1" and spark.conf.get(adaptive) == "1000000"
        assert spark.conf.get(static) == "1000000" and spark.conf.get(adaptive, None) == before[1]
    finally:
        spark.conf.unset(static) if before[0] is None else spark.conf.set(static, before[0])
    with measured_broadcasts(spark):
        assert spark.conf.get(static) == "-1"
    assert [spark.conf.get(n, None) for n in (static, adaptive)] == before


def test_batch_run_broadcasts_no_stored_table(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(1, "B", 2.0)], "c_custkey long, c_mktsegment string, c_acctbal double").write.parquet(
        f"{tmp_path}/customer.parquet")
    spark.createDataFrame(
        [(1, 1, "F", 5.0, None, "1-URGENT")],
        "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    ).write.parquet(f"{tmp_path}/orders.parquet")
    plans = []

    def stop(df, path):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        raise InterruptedError

    monkeypatch.setattr(batch, "store_halves", stop)
    with pytest.raises(InterruptedError):
        batch.both_runs(spark, str(tmp_path))
    assert "SortMergeJoin" in plans[0] and "Broadcast" not in plans[0]
    monkeypatch.setattr(claims, "_run", lambda s, *_: s.conf.get("spark.sql.autoBroadcastJoinThreshold"))
    assert claims.run(spark, {}, str(tmp_path), "1", None) == "-1"
