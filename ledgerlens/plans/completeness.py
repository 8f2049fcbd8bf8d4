"""Queries: completeness, uniqueness and format."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import completeness, uniqueness
from . import frames
from .registry import query

ORDER_COLUMNS = [
    "o_orderkey",
    "o_custkey",
    "o_orderstatus",
    "o_totalprice",
    "o_orderdate",
    "o_orderpriority",
]
_RATIOS = " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, round_even(CAST(count(*) FILTER ({c} IS NULL)
      AS DOUBLE) / count(*) * 100, 2) AS null_pct FROM clean"""
    for c in ORDER_COLUMNS
)


@query("n1_row_count", "SELECT count(*) AS row_count FROM lineitem")
def row_count(spark, folder):
    return completeness.row_count(frames.raw(spark, folder, "lineitem"))


@query("n2_null_ratio_by_column", f"WITH {frames.CLEAN_ORDERS_SQL} {_RATIOS}")
def null_ratio_by_column(spark, folder):
    return completeness.null_ratio_by_column(frames.clean_orders(spark, folder))


_ANY_NULL = " OR ".join(f"{c} IS NULL" for c in ORDER_COLUMNS)


@query(
    "n3_null_row_ratio",
    f"""WITH {frames.CLEAN_ORDERS_SQL} SELECT coalesce(
      avg(CASE WHEN {_ANY_NULL} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 100, 0) AS null_row_pct
    FROM clean""",
)
def null_row_ratio(spark, folder):
    return completeness.null_row_ratio(frames.clean_orders(spark, folder))


@query(
    "n4_default_exclusions",
    f"""WITH {frames.CLEAN_ORDERS_SQL} SELECT coalesce(
      avg(CASE WHEN o_orderstatus IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 100, 0)
      AS null_row_pct FROM clean""",
)
def default_exclusions(spark, folder):
    return completeness.null_row_ratio(
        frames.clean_orders(spark, folder), exclude=["o_orderpriority", "not_there"]
    )


_GROUPED = ", ".join(
    f"avg(CASE WHEN {c} IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS {c}_ratio"
    for c in ("order_id", "status", "priority", "claimed", "ts")
)


def _by_segment(spark, folder):
    return frames.clean_header(spark, folder).select(
        "order_id", "status", "priority", "claimed", "ts", "segment"
    )


@query(
    "n5_grouped_null_ratio",
    f"""WITH {frames.CLEAN_HEADER_SQL} SELECT segment, {_GROUPED} FROM clean
    WHERE segment IS NOT NULL GROUP BY segment""",
)
def grouped_null_ratio(spark, folder):
    return completeness.grouped_null_ratio(_by_segment(spark, folder), "segment")


_GROUPED_ROWS = """avg(CASE WHEN order_id IS NULL OR status IS NULL OR priority IS NULL
  OR claimed IS NULL OR ts IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS null_row_ratio"""


@query(
    "n6_grouped_null_row_ratio",
    f"""WITH {frames.CLEAN_HEADER_SQL} SELECT segment, {_GROUPED_ROWS} FROM clean
    WHERE segment IS NOT NULL GROUP BY segment""",
)
def grouped_null_row_ratio(spark, folder):
    return completeness.grouped_null_row_ratio(_by_segment(spark, folder), "segment")


@query(
    "n7_single_group_filter",
    f"""WITH {frames.CLEAN_HEADER_SQL} SELECT segment, {_GROUPED_ROWS} FROM clean
    WHERE segment = 'BUILDING' GROUP BY segment""",
)
def single_group_filter(spark, folder):
    return completeness.grouped_null_row_ratio(
        _by_segment(spark, folder), "segment", only="BUILDING"
    )


@query(
    "n8_top_null_columns",
    f"""WITH {frames.CLEAN_ORDERS_SQL} SELECT * FROM ({_RATIOS})
    ORDER BY null_pct DESC, column_name LIMIT 5""",
)
def top_null_columns(spark, folder):
    ratios = completeness.null_ratio_by_column(frames.clean_orders(spark, folder))
    return completeness.top_null_columns(ratios, 5)


@query(
    "n9_error_frequency_weekday_hour",
    """SELECT dayname(ts) AS weekday, CAST(hour(ts) AS INTEGER) AS hour,
      count(event_id) AS total_rows,
      count(*) FILTER (event_type = 'error') AS error_rows,
      CAST(count(*) FILTER (event_type = 'error') AS DOUBLE) / count(event_id) * 100
        AS error_rate_pct
    FROM events WHERE ts IS NOT NULL GROUP BY 1, 2""",
)
def error_frequency(spark, folder):
    events = frames.table(spark, folder, "events").select(
        "event_id",
        "ts",
        F.when(F.col("event_type") != "error", F.col("event_type")).alias("event_type"),
        "value",
    )
    return completeness.error_frequency(events, "ts", "event_id")


def _unique_sql(table: str, keys: str) -> str:
    return f"""SELECT count(*) FILTER (n > 1) = 0 AS is_unique,
      count(*) FILTER (n > 1) AS duplicate_keys,
      CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS duplicate_rows
    FROM (SELECT {keys}, count(*) AS n FROM {table} GROUP BY {keys})"""


@query("u1_single_column_unique", _unique_sql("orders", "o_orderkey"))
def single_column_unique(spark, folder):
    return uniqueness.uniqueness(frames.raw(spark, folder, "orders"), "o_orderkey")


@query("u1_single_column_repeated", _unique_sql("lineitem", "l_orderkey"))
def single_column_repeated(spark, folder):
    return uniqueness.uniqueness(frames.raw(spark, folder, "lineitem"), "l_orderkey")


@query("u2_composite_uniqueness", _unique_sql("lineitem", "l_orderkey, l_linenumber"))
def composite_uniqueness(spark, folder):
    return uniqueness.uniqueness(
        frames.raw(spark, folder, "lineitem"),
        ["l_orderkey", "l_linenumber"],
        drop_null_keys=True,
    )


@query(
    "u3_duplicate_rows",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem
    QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1""",
)
def duplicate_rows(spark, folder):
    return uniqueness.duplicate_rows(
        frames.table(spark, folder, "lineitem"),
        ["l_orderkey", "l_linenumber"],
        ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"],
    )


@query(
    "u4_overall_id_flag",
    f"""SELECT bool_and(is_unique) AS all_unique FROM (
      {_unique_sql("orders", "o_orderkey")} UNION ALL
      {_unique_sql("lineitem", "l_orderkey")} UNION ALL
      {_unique_sql("lineitem", "l_orderkey, l_linenumber")})""",
)
def overall_id_flag(spark, folder):
    orders = frames.raw(spark, folder, "orders")
    items = frames.raw(spark, folder, "lineitem")
    return uniqueness.all_true(
        [
            uniqueness.uniqueness(orders, "o_orderkey"),
            uniqueness.uniqueness(items, "l_orderkey"),
            uniqueness.uniqueness(items, ["l_orderkey", "l_linenumber"], True),
        ]
    )


@query(
    "f1_id_format_check",
    """SELECT * FROM (SELECT p_name, length(p_name) <> 10 AS bad_length,
        coalesce(length(string_split(p_name, ' ')[1]) <> 5, true) AS bad_segment_0,
        coalesce(length(string_split(p_name, ' ')[2]) <> 4, true) AS bad_segment_1
      FROM part WHERE p_name IS NOT NULL)
    WHERE bad_length OR bad_segment_0 OR bad_segment_1""",
)
def id_format_check(spark, folder):
    return uniqueness.id_format_violations(
        frames.table(spark, folder, "part"), "p_name", 10, (5, 4), " "
    )


@query(
    "f1_id_format_clean",
    """SELECT c_name, false AS bad_length, false AS bad_segment_0, false AS bad_segment_1
    FROM customer WHERE length(c_name) <> 18 OR length(string_split(c_name, '#')[1]) <> 8
      OR coalesce(length(string_split(c_name, '#')[2]) <> 9, true)""",
)
def id_format_clean(spark, folder):
    return uniqueness.id_format_violations(
        frames.table(spark, folder, "customer"), "c_name", 18, (8, 9), "#"
    )


@query(
    "f2_segment_value_counts",
    """SELECT CAST(position AS INTEGER) AS position, value, count(*) AS occurrences FROM (
      SELECT unnest(string_split(p_name, ' ')) AS value,
        generate_subscripts(string_split(p_name, ' '), 1) - 1 AS position FROM part)
    GROUP BY 1, 2""",
)
def segment_value_counts(spark, folder):
    return uniqueness.segment_value_counts(frames.table(spark, folder, "part"), "p_name", " ")
