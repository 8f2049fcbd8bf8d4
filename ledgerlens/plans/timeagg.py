"""Queries: time aggregates, distributions and top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..functions.values import off_by
from ..operators import checks, distribution, timeagg
from . import frames
from .checks import (
    OVERSHOOT_SQL,
    RECONCILED_SQL,
    RESIDUAL_OFF,
    overshoots,
)
from .registry import query


@query(
    "a1_line_count_per_order",
    """SELECT l_orderkey AS order_id, count(l_linenumber) AS line_count FROM lineitem
    WHERE l_orderkey IS NOT NULL GROUP BY l_orderkey""",
)
def line_count_per_order(spark, folder):
    return timeagg.line_counts(frames.lines(spark, folder), "order_id", "line_no")


def _orders(spark, folder):
    return frames.table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("order_id"), F.col("o_orderdate").alias("ts")
    )


def monthly(spark, folder):
    counts = timeagg.line_counts(frames.lines(spark, folder), "order_id", "line_no")
    return timeagg.lines_per_order_by_month(_orders(spark, folder), counts, "order_id", "ts")


MONTHLY_SQL = """per_order AS (
  SELECT strftime(o_orderdate, '%Y-%m') AS period, coalesce(n, 0) AS n FROM orders
  LEFT JOIN (SELECT l_orderkey, count(l_linenumber) AS n FROM lineitem GROUP BY l_orderkey)
    ON o_orderkey = l_orderkey WHERE o_orderdate IS NOT NULL),
monthly AS (
  SELECT period, CAST(sum(n) AS DOUBLE) / count(*) AS avg_lines,
    CAST(sum(n) AS BIGINT) AS total_lines, count(*) AS orders FROM per_order GROUP BY period),
grown AS (
  SELECT *, (avg_lines - lag(avg_lines) OVER (ORDER BY period))
    / lag(avg_lines) OVER (ORDER BY period) * 100 AS growth_pct FROM monthly)"""


@query(
    "a2_lines_per_order_by_month",
    f"""WITH {MONTHLY_SQL} SELECT period, avg_lines, total_lines, orders FROM grown""",
)
def lines_per_order_by_month(spark, folder):
    return monthly(spark, folder).drop("growth_pct")


@query("a3_growth_rate", f"WITH {MONTHLY_SQL} SELECT * FROM grown")
def growth_rate(spark, folder):
    return monthly(spark, folder)


@query(
    "a4_month_range_filter",
    f"WITH {MONTHLY_SQL} SELECT * FROM grown WHERE period BETWEEN '1996-03' AND '1998-06'",
)
def month_range_filter(spark, folder):
    return timeagg.month_range(monthly(spark, folder), "period", "1996-03", "1998-06")


@query(
    "a5_trend_highlights",
    f"""WITH {MONTHLY_SQL}, marks AS (
      (SELECT period, avg_lines, 'Last' AS label, 0 AS r FROM grown ORDER BY period DESC LIMIT 1)
      UNION ALL (SELECT period, avg_lines, 'Min', 1 FROM grown ORDER BY avg_lines, period LIMIT 1)
      UNION ALL (SELECT period, avg_lines, 'Max', 2 FROM grown
        ORDER BY avg_lines DESC, period LIMIT 1))
    SELECT period, avg_lines, label FROM marks
    QUALIFY row_number() OVER (PARTITION BY period ORDER BY r DESC) = 1""",
)
def trend_highlights(spark, folder):
    return timeagg.trend_highlights(monthly(spark, folder), "period", "avg_lines")


@query(
    "a6_trend_classification",
    f"""WITH {MONTHLY_SQL}, ends AS (
      SELECT first(avg_lines ORDER BY period) AS a, last(avg_lines ORDER BY period) AS z,
        date_diff('day', CAST(min(period) || '-01' AS DATE),
          CAST(max(period) || '-01' AS DATE)) // 30 AS months FROM grown),
    c AS (SELECT (z - a) / a * 100 AS change_pct, CAST(months AS BIGINT) AS months FROM ends)
    SELECT change_pct, months, CASE WHEN change_pct IS NULL THEN 'too short'
      WHEN abs(change_pct) < 2 THEN 'stable'
      WHEN abs(change_pct) < 8 THEN 'slight ' || CASE WHEN change_pct > 0 THEN 'rise' ELSE 'fall' END
      ELSE 'strong ' || CASE WHEN change_pct > 0 THEN 'rise' ELSE 'fall' END END AS trend
    FROM c""",
)
def trend_classification(spark, folder):
    return timeagg.trend_class(monthly(spark, folder), "period", "avg_lines")


def _incidents(spark, folder):
    """All rules on the headers with their line gaps: orders and lines are read once."""
    totals = checks.line_totals(frames.lines(spark, folder), "order_id", "claimed", "claimed")
    slim = frames.header(spark, folder).select("order_id", "claimed", "agreed", "residual", "ts")
    rows = checks.with_line_gaps(slim, totals, "order_id", "claimed", "agreed")
    amounts = F.col("claimed"), F.col("agreed"), F.col("residual")
    tests = {
        "residual": rules.residual_is_off(*amounts),
        "high value": rules.at_least(F.col("agreed"), 490000),
        "sum mismatch": off_by(F.col("claimed_gap")) | off_by(F.col("agreed_gap")),
    }
    return timeagg.monthly_rule_incidents(rows, tests, "ts")


INCIDENT_SQL = f"""{RECONCILED_SQL},
incidents AS (
  SELECT ts, 'residual' AS category FROM header WHERE {RESIDUAL_OFF}
  UNION ALL SELECT ts, 'high value' FROM header WHERE agreed >= 490000
  UNION ALL SELECT ts, 'sum mismatch' FROM gaps WHERE claimed_diff <> 0 OR agreed_diff <> 0),
trend AS (SELECT CAST(date_trunc('month', ts) AS TIMESTAMP) AS month, count(*) AS incidents,
    category FROM incidents WHERE ts IS NOT NULL GROUP BY 1, 3)"""


@query("a7_monthly_incident_trend", f"WITH {INCIDENT_SQL} SELECT * FROM trend")
def monthly_incident_trend(spark, folder):
    return _incidents(spark, folder)


@query(
    "a8_category_filter",
    f"""WITH {INCIDENT_SQL} SELECT * FROM trend WHERE category IN ('residual', 'high value')
    AND month BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-12-01'""",
)
def category_filter(spark, folder):
    trend = _incidents(spark, folder)
    first, last = [F.lit(d).cast("timestamp_ntz") for d in ("1996-01-01", "1997-12-01")]
    return timeagg.filter_categories(trend, ["residual", "high value"], first, last)


@query(
    "a9_labelled_rows",
    f"""WITH {frames.HEADER_SQL} SELECT * FROM (
      SELECT 'test data' AS category, order_id, segment, ts, NULL::DOUBLE AS claimed
      FROM header WHERE contains(lower(segment), 'build')
      UNION ALL SELECT 'high value', order_id, NULL, ts, claimed
      FROM header WHERE claimed >= 490000)
    WHERE CAST(ts AS DATE) BETWEEN DATE '1997-01-01' AND DATE '1997-06-30'""",
)
def labelled_rows(spark, folder):
    header = frames.header(spark, folder)
    tests = {
        "test data": (
            rules.name_contains(F.col("segment"), "build"), ["order_id", "segment", "ts"]
        ),
        "high value": (rules.at_least(F.col("claimed"), 490000), ["order_id", "ts", "claimed"]),
    }
    return timeagg.flagged_rows(header, tests, "ts", "1997-01-01", "1997-06-30")


@query(
    "a10_monthly_pro_forma_count",
    """SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS month,
      count(*) AS occurrences FROM orders WHERE o_totalprice BETWEEN 1000 AND 11000
    GROUP BY 1""",
)
def monthly_pro_forma_count(spark, folder):
    orders = frames.raw(spark, folder, "orders")
    rows = checks.rule_rows(orders, rules.in_range(F.col("o_totalprice"), 1000, 11000))
    return timeagg.rows_by_month(rows, "o_orderdate")


_OUTLIER_SQL = """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate,
  o_orderpriority FROM (
    SELECT *, quantile_cont(o_totalprice, 0.99) OVER (PARTITION BY o_orderpriority) AS hi,
      quantile_cont(o_totalprice, 0.01) OVER (PARTITION BY o_orderpriority) AS lo FROM orders)
WHERE (o_totalprice > hi OR o_totalprice < lo) AND o_orderpriority IS NOT NULL"""


@query("a11_group_quantile_outliers", _OUTLIER_SQL)
def group_quantile_outliers(spark, folder):
    orders = frames.table(spark, folder, "orders")
    return distribution.group_outliers(orders, "o_orderpriority", "o_totalprice")


@query(
    "a11_group_quantile_outliers_one_kind",
    _OUTLIER_SQL + " AND o_orderpriority = '2-HIGH'",
)
def group_quantile_outliers_one_kind(spark, folder):
    orders = frames.table(spark, folder, "orders")
    return distribution.group_outliers(
        orders, "o_orderpriority", "o_totalprice", 0.01, only="2-HIGH"
    )


@query(
    "a11_group_quantile_outliers_bucketed",
    """SELECT l_orderkey, l_linenumber, l_suppkey, l_extendedprice FROM (
      SELECT *, quantile_cont(l_extendedprice, 0.99) OVER (PARTITION BY l_suppkey) AS hi,
        quantile_cont(l_extendedprice, 0.01) OVER (PARTITION BY l_suppkey) AS lo FROM lineitem)
    WHERE l_extendedprice > hi OR l_extendedprice < lo""",
)
def group_quantile_outliers_bucketed(spark, folder):
    items = frames.table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice"
    )
    return distribution.group_outliers(items, "l_suppkey", "l_extendedprice", buckets=64)


_P95 = "p AS (SELECT coalesce(quantile_cont(diff, 0.95), 0) AS p95 FROM over)"


def _p95(spark, folder, **options):
    diffs = overshoots(spark, folder)
    return distribution.quantile_value(diffs, "diff", 0.95, "p95", **options)


@query("a12_p95_of_differences", f"WITH {OVERSHOOT_SQL}, {_P95} SELECT round(p95, 6) AS p95 FROM p")
def p95_of_differences(spark, folder):
    return _p95(spark, folder).select(F.round("p95", 6).alias("p95"))


@query(
    "a13_histogram",
    f"""WITH {OVERSHOOT_SQL}, {_P95},
    kept AS (SELECT diff FROM over, p WHERE diff <= CASE WHEN p95 > 0 THEN p95 * 1.5 ELSE 100 END),
    b AS (SELECT min(diff) AS lo, (max(diff) - min(diff)) / 10.0::DOUBLE AS width FROM kept)
    SELECT least(CAST(floor((diff - lo) / width) AS INTEGER), 9) AS bin,
      count(*) AS occurrences, min(diff) AS smallest, max(diff) AS largest
    FROM kept, b GROUP BY 1""",
)
def histogram(spark, folder):
    return distribution.histogram(overshoots(spark, folder), "diff", _p95(spark, folder))


@query(
    "a14_extreme_rows",
    f"""WITH {OVERSHOOT_SQL}, {_P95} SELECT order_id, line_no, claimed, agreed, diff
    FROM over, p WHERE diff > CASE WHEN p95 > 0 THEN p95 ELSE '-inf'::DOUBLE END
    ORDER BY diff DESC, order_id, line_no, claimed LIMIT 10""",
)
def extreme_rows(spark, folder):
    return distribution.extreme_rows(
        overshoots(spark, folder),
        "diff",
        _p95(spark, folder),
        ["order_id", "line_no", "claimed"],
    )


@query(
    "a15_top_value_counts",
    """SELECT p_name, count(*) AS occurrences FROM part WHERE p_name IS NOT NULL
    GROUP BY p_name ORDER BY occurrences DESC, p_name LIMIT 10""",
)
def top_value_counts(spark, folder):
    return timeagg.top_values(frames.table(spark, folder, "part"), "p_name")


@query(
    "a16_top_companies_by_sum",
    """SELECT l_suppkey AS supplier_id, CAST(sum(n) AS BIGINT) AS total FROM (
      SELECT l_suppkey, p_type, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey
      GROUP BY 1, 2) GROUP BY l_suppkey ORDER BY total DESC, supplier_id LIMIT 10""",
)
def top_companies_by_sum(spark, folder):
    from .text import supplier_types

    pairs = supplier_types(spark, folder)
    return timeagg.top_by_sum(pairs, "supplier_id", "pair_count")


@query(
    "a17_filter_options",
    "SELECT DISTINCT nullif(o_orderpriority, '4-NOT SPECIFIED') AS o_orderpriority FROM orders",
)
def filter_options(spark, folder):
    return timeagg.options(frames.clean_orders(spark, folder), "o_orderpriority")


@query(
    "a17_multi_value_filter",
    "SELECT * FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')",
)
def multi_value_filter(spark, folder):
    orders = frames.table(spark, folder, "orders")
    return timeagg.filter_selection(orders, "o_orderpriority", ["1-URGENT", "5-LOW"])


@query(
    "a18_time_span",
    "SELECT min(o_orderdate) AS first_ts, max(o_orderdate) AS last_ts FROM orders",
)
def time_span(spark, folder):
    return timeagg.time_span(frames.raw(spark, folder, "orders"), "o_orderdate")
