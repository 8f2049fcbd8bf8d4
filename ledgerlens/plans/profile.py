"""Queries: column profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile, sketches
from . import frames
from .completeness import ORDER_COLUMNS
from .registry import query

LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _profile_sql(table: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, count({c}) AS count, round(avg({c}), 6) AS mean,
      round(stddev_samp({c}), 6) AS std, min({c}) AS min,
      round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50,
      round(quantile_cont({c}, 0.75), 6) AS p75, max({c}) AS max FROM {table}"""
        for c in columns
    )


def _rounded(df):
    return df.withColumns(
        {c: F.round(c, 6) for c in ("mean", "std", "p25", "p50", "p75")}
    )


@query("p1_numeric_profile_orders", _profile_sql("orders", ["o_totalprice"]))
def numeric_profile_orders(spark, folder):
    orders = frames.table(spark, folder, "orders")
    return _rounded(profile.numeric_profile(orders, ["o_totalprice"]))


@query("p1_numeric_profile_lines", _profile_sql("lineitem", LINE_NUMBERS))
def numeric_profile_lines(spark, folder):
    items = frames.table(spark, folder, "lineitem")
    return _rounded(profile.numeric_profile(items, LINE_NUMBERS))


@query("p1_numeric_profile_bucketed", _profile_sql("lineitem", LINE_NUMBERS))
def numeric_profile_bucketed(spark, folder):
    items = frames.table(spark, folder, "lineitem")
    return _rounded(profile.numeric_profile(items, LINE_NUMBERS, buckets=64))


@query(
    "p2_distinct_values",
    f"""WITH {frames.CLEAN_ORDERS_SQL}
    SELECT DISTINCT 'o_orderpriority' AS column_name, o_orderpriority AS value FROM clean
    UNION ALL SELECT DISTINCT 'o_orderstatus', o_orderstatus FROM clean""",
)
def distinct_values(spark, folder):
    return profile.distinct_values(
        frames.clean_orders(spark, folder), ["o_orderpriority", "o_orderstatus"]
    )


COUNTED = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"]


@query(
    "p3_value_counts",
    f"WITH {frames.CLEAN_ORDERS_SQL} "
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, count(*) AS occurrences
      FROM clean WHERE {c} IS NOT NULL GROUP BY 2"""
        for c in COUNTED
    ),
)
def value_counts(spark, folder):
    return profile.value_counts(frames.clean_orders(spark, folder), COUNTED)


_TYPES = {
    "BIGINT": "bigint",
    "VARCHAR": "string",
    "DOUBLE": "double",
    "TIMESTAMP": "timestamp_ntz",
}


@query(
    "p4_schema_profile",
    " UNION ALL ".join(
        f"""(SELECT CAST({i} AS INTEGER) AS position, '{c}' AS column_name,
      CASE any_value(typeof({c})) {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _TYPES.items())}
      END AS data_type, count({c}) AS non_null, count(DISTINCT {c}) AS distinct_values FROM orders)"""
        for i, c in enumerate(ORDER_COLUMNS)
    ),
)
def schema_profile(spark, folder):
    return profile.schema_profile(frames.raw(spark, folder, "orders"))


@query("p4_preview", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 1000")
def preview(spark, folder):
    return profile.preview(frames.raw(spark, folder, "orders"), ["o_orderkey"])


SKETCHED = ["l_orderkey", "l_partkey", "l_quantity", "l_extendedprice"]


def _ship_month(name: str = "l_shipdate"):
    return F.date_format(name, "yyyy-MM")


def sketch_bounds(df, columns: list[str], merged):
    """Profile of merged sketches, with what the exact figures say about its errors.

    Exact ranks of the estimated medians and exact distinct values come from one count of
    equal values; ``merged`` is one row per column.
    """
    found = sketches.sketch_profile(merged)
    values = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    equal = values.unpivot([], columns, "column_name", "value").where("value IS NOT NULL")
    equal = equal.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    # one row per column
    beside = equal.join(F.broadcast(found.select("column_name", "p50")), "column_name")
    exact = beside.groupBy("column_name").agg(
        F.count(F.lit(1)).alias("distinct_exact"),
        (F.sum(F.when(F.col("value") < F.col("p50"), F.col("n")).otherwise(0)) / F.sum("n")).alias("below"),
        (F.sum(F.when(F.col("value") <= F.col("p50"), F.col("n")).otherwise(0)) / F.sum("n")).alias("upto"),
    )
    gap = F.abs(F.col("distinct_values") - F.col("distinct_exact"))
    return found.join(exact, "column_name").select(
        "column_name", "row_count", "count", "min", "max", "distinct_exact",
        (gap <= sketches.DISTINCT_ERROR * F.col("distinct_exact")).alias("distinct_within_bound"),
        ((F.col("below") <= 0.5 + sketches.RANK_ERROR) & (F.col("upto") >= 0.5 - sketches.RANK_ERROR))
        .alias("median_within_bound"),
    )


@query(
    "p1_sketch_profile_bounds",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, count(*) AS row_count, count({c}) AS count,
      CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max,
      count(DISTINCT {c}) AS distinct_exact, true AS distinct_within_bound,
      true AS median_within_bound FROM lineitem"""
        for c in SKETCHED
    ),
)
def sketch_profile_bounds(spark, folder):
    """Monthly sketches merged into one profile; its estimates stay within the stated errors."""
    items = frames.table(spark, folder, "lineitem")
    monthly = sketches.column_sketches(items, SKETCHED, {"month": _ship_month()})
    return sketch_bounds(items, SKETCHED, sketches.merge_sketches(monthly))


@query(
    "p2_sketch_distinct_by_month",
    """SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS row_count,
      count(o_custkey) AS count, CAST(min(o_custkey) AS DOUBLE) AS min,
      CAST(max(o_custkey) AS DOUBLE) AS max, true AS distinct_within_bound
    FROM orders GROUP BY 1""",
)
def sketch_distinct_by_month(spark, folder):
    """Customers per month from sketches, held against the exact number."""
    orders = frames.table(spark, folder, "orders")
    month = F.date_format("o_orderdate", "yyyy-MM")
    found = sketches.sketch_profile(sketches.column_sketches(orders, ["o_custkey"], {"month": month}))
    exact = orders.select(month.alias("month"), "o_custkey").groupBy("month", "o_custkey").count()
    exact = exact.groupBy("month").agg(F.count("o_custkey").alias("exact"))
    joined = found.join(exact, found.month.eqNullSafe(exact.month)).select(found["*"], "exact")
    gap = F.abs(F.col("distinct_values") - F.col("exact"))
    return joined.select(
        "month", "row_count", "count", "min", "max",
        (gap <= sketches.DISTINCT_ERROR * F.col("exact")).alias("distinct_within_bound"),
    )
