"""Physical plans: what reaches the scan, and what must never appear."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from ledgerlens.operators import checks, timeagg, uniqueness
from ledgerlens.operators.joins import attach, broadcast_if_small, row_bytes

FOLDER = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables missing")


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


#: whole batch runs, which tests/test_runs.py looks at
BATCH = {"k4_batch_comparison", "s3_batch_run_tables"}


@needs_data
@pytest.mark.parametrize("name", sorted(set(contract.QUERIES) - BATCH))
def test_no_cross_join_and_no_row_python(spark, name):
    text = physical(contract.queries()[name](spark, FOLDER))
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython",
                 "ArrowEvalPython", "PythonUDF"):
        assert node not in text
    assert "MapInPandas" not in text or name in (
        "t4_semantic_mismatch_encoded", "t5_distinct_value_encode")


@needs_data
@pytest.mark.parametrize(
    "name, expected",
    [
        ("r2_pro_forma_receipts", "GreaterThanOrEqual(o_totalprice,1000.0)"),
        ("r3_high_value", "GreaterThanOrEqual(o_totalprice,490000.0)"),
        ("d1_date_slice", "GreaterThanOrEqual(o_orderdate"),
        ("a17_multi_value_filter", "In(o_orderpriority"),
    ],
)
def test_filters_reach_the_scan(spark, name, expected):
    text = physical(contract.queries()[name](spark, FOLDER))
    pushed = [line for line in text.splitlines() if "PushedFilters" in line]
    assert any(expected in line for line in pushed)


@needs_data
def test_slice_of_a_table_stored_by_month_skips_other_months(spark):
    text = physical(contract.queries()["d1_date_slice_pruned"](spark, FOLDER))
    scan = [line for line in text.splitlines() if "PartitionFilters" in line]
    assert "month" in scan[0].split("PartitionFilters: [")[1].split("]")[0]


@needs_data
def test_a_result_used_twice_is_shuffled_once(spark):
    df = contract.queries()["t1_association_stats"](spark, FOLDER)
    n, text = done(df)
    final = text.split("== Initial Plan ==")[0]
    assert n > 0 and final.count("FileScan parquet [l_partkey") == 1


@needs_data
def test_only_needed_columns_are_read(spark):
    text = physical(contract.queries()["a1_line_count_per_order"](spark, FOLDER))
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int>" in text


@pytest.fixture
def splitting(spark):
    """Thresholds so low that a few kilobytes already count as a skewed partition."""
    low = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k",
    }
    old = {key: spark.conf.get(key, None) for key in low}
    for key, value in low.items():
        spark.conf.set(key, value)
    yield
    for key, value in old.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def skewed_lines(spark):
    """Half of 40,000 rows share one key."""
    hot = F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 5000)
    wide = F.sha2(F.col("id").cast("string"), 256)
    return spark.range(0, 40000, 1, 8).select(
        hot.alias("key"), F.col("id").alias("line_no"), wide.alias("text"),
        F.lit(1.0).alias("claimed"),
    )


def done(df):
    """Final plan text after a run."""
    rows = df.collect()
    return len(rows), physical(df)


def test_hot_key_is_split_when_an_aggregate_is_joined_back(spark, splitting):
    lines = skewed_lines(spark)
    counts = timeagg.line_counts(lines, "key", "line_no")
    n, text = done(attach(lines, counts, "key"))
    assert n == 40000 and "SortMergeJoin(skew=true)" in text


def test_duplicate_rows_split_a_hot_key(spark, splitting):
    n, text = done(uniqueness.duplicate_rows(skewed_lines(spark), ["key"]))
    assert n == 40000 and "SortMergeJoin(skew=true)" in text and "Window" not in text


def test_header_side_with_a_hot_key_is_split(spark, splitting):
    header = skewed_lines(spark).withColumn("agreed", F.col("claimed"))
    totals = checks.line_totals(header, "key", "claimed", "agreed")
    found = checks.reconciliation_rows(header, totals, "key", "claimed", "agreed", ["text"])
    n, text = done(found)
    assert "SortMergeJoin(skew=true)" in text
    assert n == 40000 - header.groupBy("key").count().filter("count = 1").count()


def test_broadcast_only_within_the_row_limit(spark):
    left = spark.range(1000).withColumnRenamed("id", "key")
    side = spark.range(100).select(F.col("id").alias("key"), F.lit(1).alias("x"))
    width = row_bytes(side)
    small = physical(left.join(broadcast_if_small(side, 100 * width), "key"))
    assert "BroadcastHashJoin" in small
    hinted = plan(left.join(broadcast_if_small(side, 100 * width - 1), "key"))
    assert "strategy=broadcast" not in hinted


def scans(df):
    """File scans in the plan, reused exchanges aside."""
    plan = df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    return [line for line in plan.splitlines() if "FileScan parquet" in line]


def of_table(found, name):
    return [line for line in found if f"/{name}.parquet" in line]


def test_two_runs_are_compared_in_one_pass(spark):
    """Header, lines and both keys: no more scans for two periods than for one."""
    one = scans(contract.queries()["k1_scalar_kpi_table"](spark, FOLDER))
    two = scans(contract.queries()["k4_run_comparison"](spark, FOLDER))
    for name in ("part", "supplier"):
        assert len(of_table(one, name)) == len(of_table(two, name)) == 1
    # header and its keys, and the header of the lines; line counts, lines, line keys
    assert len(of_table(one, "orders")) == 3 and len(of_table(one, "lineitem")) == 3
    # the keys of lines, cut by the date of their order, read the orders once more
    assert len(of_table(two, "orders")) == 4 and len(of_table(two, "lineitem")) == 3


def test_lines_belong_to_the_period_of_their_order(spark):
    found = contract.queries()["k4_run_comparison"](spark, FOLDER).collect()
    change = {r["metric"]: r["absolute_change"] for r in found}
    lines = [m for m in change if m in ("count_total_lines", "count_overshoot_line", "count_discount_errors")]
    assert len(lines) == 3 and all(change[m] > 0 for m in lines) and change["count_total_orders"] > 0
    old = {r["metric"]: r["old_value"] for r in found}
    items = spark.read.parquet(f"{FOLDER}/lineitem.parquet")
    orders = spark.read.parquet(f"{FOLDER}/orders.parquet").where("o_orderdate < TIMESTAMP_NTZ '2001-01-01'")
    assert old["count_total_lines"] == items.join(orders, items.l_orderkey == orders.o_orderkey).count()


def test_a_profile_scans_its_table_twice_whatever_the_columns(spark):
    """Plain figures and value counts; the counts are stored, and only those are read again."""
    from unittest import mock

    from ledgerlens.operators import distribution

    items = spark.read.parquet(f"{FOLDER}/lineitem.parquet")
    made = []
    with mock.patch.object(distribution, "pin", lambda df: made.append(df) or df):
        rows = items.selectExpr("l_quantity q", "l_tax t").unpivot([], ["q", "t"], "column_name", "_v")
        distribution.ordered_counts(rows, ["column_name"], "_v", [F.count(F.lit(1)).alias("_n")])
    assert len(made) == 1 and len(scans(made[0])) == 1
    found = contract.queries()["p1_numeric_profile_lines"](spark, FOLDER)
    assert len(scans(found)) == 1


@needs_data
@pytest.mark.parametrize("name", ["a7_monthly_incident_trend", "a8_category_filter", "a9_labelled_rows"])
def test_rules_of_one_table_share_a_scan(spark, name):
    text = physical(contract.queries()[name](spark, FOLDER))
    first = text.split("+- == Initial Plan ==")[0]
    read = [line.split("/")[-1].split(".parquet")[0] for line in first.splitlines() if "FileScan" in line]
    assert sorted(read) == sorted(set(read)) and "orders" in read


@needs_data
@pytest.mark.parametrize("name", ["p1_sketch_profile_bounds", "p2_sketch_distinct_by_month"])
def test_sketches_are_combined_before_the_shuffle(spark, name):
    text = physical(contract.queries()[name](spark, FOLDER))
    assert "partial_hll_sketch_agg" in text and "partial_kll_sketch_agg_double" in text
