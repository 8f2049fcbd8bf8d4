"""Queries: drift between date ranges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dates import month_label
from ..operators import drift
from ..operators.drift import DriftRoles
from ..sources.drift_store import DriftStore
from ..sources.tables import write_table
from . import frames
from .registry import query

ORDER_ROLES = DriftRoles("o_orderdate", ["o_totalprice"], ["o_orderpriority", "o_orderstatus"])
EVENT_ROLES = DriftRoles("ts", ["value"], ["event_type"])
LINE_ROLES = DriftRoles("l_shipdate", ["l_quantity", "l_extendedprice", "l_discount"])

YEAR_1995 = ("1995-01-01", "1996-01-01")
YEAR_1996 = ("1996-01-01", "1997-01-01")
FIRST_HALF = ("2024-01-01", "2024-01-16")
SECOND_HALF = ("2024-01-16", "2024-02-01")


def _between(ts: str, days: tuple[str, str]) -> str:
    return f"({ts} >= TIMESTAMP '{days[0]}' AND {ts} < TIMESTAMP '{days[1]}')"


def w1_sql(table: str, ts: str, column: str, ref: tuple, cur: tuple, normed: bool) -> str:
    """Distance between empirical distributions by prefix sums over distinct values."""
    scale = f"""greatest((SELECT stddev_pop({column}) FROM {table}
      WHERE {_between(ts, ref)}), 0.001)"""
    divide = f" / {scale}" if normed else ""
    return f"""SELECT '{column}' AS column_name,
      round(sum(abs(f / fa - g / ga) * gap){divide}, 9) AS distance FROM (
      SELECT sum(r) OVER (ORDER BY v) AS f, sum(c) OVER (ORDER BY v) AS g,
        CAST(sum(r) OVER () AS DOUBLE) AS fa, CAST(sum(c) OVER () AS DOUBLE) AS ga,
        coalesce(lead(v) OVER (ORDER BY v) - v, 0) AS gap
      FROM (SELECT {column} AS v, count(*) FILTER ({_between(ts, ref)}) AS r,
          count(*) FILTER ({_between(ts, cur)}) AS c FROM {table}
        WHERE {column} IS NOT NULL AND ({_between(ts, ref)} OR {_between(ts, cur)})
        GROUP BY 1))"""


def js_sql(table: str, ts: str, column: str, ref: tuple, cur: tuple) -> str:
    return f"""SELECT '{column}' AS column_name, round(sqrt(sum(
        CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END
        + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2), 9) AS distance
      FROM (SELECT r / sum(r) OVER () AS p, c / sum(c) OVER () AS q FROM (
        SELECT CAST(count(*) FILTER ({_between(ts, ref)}) AS DOUBLE) AS r,
          CAST(count(*) FILTER ({_between(ts, cur)}) AS DOUBLE) AS c
        FROM {table} WHERE {column} IS NOT NULL GROUP BY {column}))"""


@query(
    "d1_date_slice",
    f"SELECT * FROM orders WHERE {_between('o_orderdate', YEAR_1995)}",
)
def date_slice(spark, folder):
    orders = frames.raw(spark, folder, "orders")
    return drift.date_slice(orders, "o_orderdate", *YEAR_1995)


@query(
    "d1_date_slice_swapped",
    f"SELECT event_id, ts, event_type FROM events WHERE {_between('ts', FIRST_HALF)}",
)
def date_slice_swapped(spark, folder):
    events = frames.raw(spark, folder, "events").select("event_id", "ts", "event_type")
    return drift.date_slice(events, "ts", FIRST_HALF[1], FIRST_HALF[0])


@query(
    "d1_date_slice_pruned",
    f"SELECT * FROM orders WHERE {_between('o_orderdate', YEAR_1996)}",
)
def date_slice_pruned(spark, folder):
    """Orders stored by month; the slice reads the twelve folders it needs."""
    path = frames.scratch(spark)
    orders = frames.raw(spark, folder, "orders")
    by_month = orders.withColumn("month", month_label("o_orderdate"))
    write_table(by_month, path, partition_by=["month"])
    stored = frames.read_raw(spark, path)
    return drift.date_slice(stored, "o_orderdate", *YEAR_1996, month="month").drop("month")


def _rounded(df):
    return df.withColumn("distance", F.round("distance", 9))


@query(
    "d2_wasserstein",
    w1_sql("events", "ts", "value", FIRST_HALF, SECOND_HALF, normed=False),
)
def wasserstein(spark, folder):
    events = frames.table(spark, folder, "events")
    return _rounded(drift.wasserstein(events, EVENT_ROLES, FIRST_HALF, SECOND_HALF))


@query(
    "d2_wasserstein_bucketed",
    " UNION ALL ".join(
        w1_sql("lineitem", "l_shipdate", c, YEAR_1995, YEAR_1996, normed=True)
        for c in LINE_ROLES.numeric
    ),
)
def wasserstein_bucketed(spark, folder):
    items = frames.table(spark, folder, "lineitem")
    found = drift.wasserstein(
        items, LINE_ROLES, YEAR_1995, YEAR_1996, normed=True, buckets=64
    )
    return _rounded(found)


@query(
    "d3_jensen_shannon",
    " UNION ALL ".join(
        js_sql("orders", "o_orderdate", c, YEAR_1995, YEAR_1996)
        for c in ORDER_ROLES.categorical
    ),
)
def jensen_shannon(spark, folder):
    orders = frames.table(spark, folder, "orders")
    return _rounded(drift.jensen_shannon(orders, ORDER_ROLES, YEAR_1995, YEAR_1996))


def _report_sql(table: str, ts: str, roles: DriftRoles, ref: tuple, cur: tuple) -> str:
    numeric = [w1_sql(table, ts, c, ref, cur, normed=True) for c in roles.numeric]
    labels = [js_sql(table, ts, c, ref, cur) for c in roles.categorical]
    parts = [
        f"SELECT column_name, 'numeric' AS kind, 'wasserstein_normed' AS method, distance FROM ({s})"
        for s in numeric
    ] + [
        f"SELECT column_name, 'categorical' AS kind, 'jensen_shannon' AS method, distance FROM ({s})"
        for s in labels
    ]
    return f"""WITH rows AS (SELECT *, 0.1::DOUBLE AS threshold,
        coalesce(distance >= 0.1, false) AS drifted FROM ({" UNION ALL ".join(parts)}))
      SELECT * FROM rows UNION ALL SELECT '(dataset)', 'dataset', 'share_drifted',
        round(avg(CAST(drifted AS INTEGER)), 9), 0.5, avg(CAST(drifted AS INTEGER)) >= 0.5
      FROM rows"""


@query(
    "d4_drift_report_orders",
    _report_sql("orders", "o_orderdate", ORDER_ROLES, YEAR_1995, YEAR_1996),
)
def drift_report_orders(spark, folder):
    orders = frames.table(spark, folder, "orders")
    return _rounded(drift.drift_report(orders, ORDER_ROLES, YEAR_1995, YEAR_1996))


# Amounts and labels of the later year are moved, so that both kinds drift.
_MOVED_SQL = """(SELECT o_orderdate,
  o_totalprice * CASE WHEN year(o_orderdate) = 1996 THEN 1.5::DOUBLE ELSE 1::DOUBLE END AS moved,
  o_totalprice AS kept,
  CASE WHEN year(o_orderdate) = 1996 AND o_orderstatus = 'F' THEN 'O' ELSE o_orderstatus END
    AS label FROM orders)"""
MOVED_ROLES = DriftRoles("o_orderdate", ["moved", "kept"], ["label"])


@query(
    "d4_drift_report_moved",
    _report_sql(_MOVED_SQL, "o_orderdate", MOVED_ROLES, YEAR_1995, YEAR_1996),
)
def drift_report_moved(spark, folder):
    later = F.year("o_orderdate") == 1996
    orders = frames.table(spark, folder, "orders").select(
        "o_orderdate",
        (F.col("o_totalprice") * F.when(later, 1.5).otherwise(1.0)).alias("moved"),
        F.col("o_totalprice").alias("kept"),
        F.when(later & (F.col("o_orderstatus") == "F"), "O")
        .otherwise(F.col("o_orderstatus")).alias("label"),
    )
    return _rounded(drift.drift_report(orders, MOVED_ROLES, YEAR_1995, YEAR_1996))


@query(
    "d4_drift_report_lines",
    _report_sql("lineitem", "l_shipdate", LINE_ROLES, YEAR_1995, YEAR_1996),
)
def drift_report_lines(spark, folder):
    items = frames.table(spark, folder, "lineitem")
    return _rounded(drift.drift_report(items, LINE_ROLES, YEAR_1995, YEAR_1996))


@query(
    "d5_default_windows",
    """SELECT CAST(m AS DATE) AS reference_start, CAST(m AS DATE) + 182 AS reference_end,
      CAST(m AS DATE) + 182 AS current_start, CAST(m AS DATE) + 364 AS current_end
    FROM (SELECT min(o_orderdate) AS m FROM orders)""",
)
def default_windows(spark, folder):
    return drift.default_windows(frames.raw(spark, folder, "orders"), "o_orderdate")


def _stored(spark, folder):
    """Report twice into a fresh store; the second call only reads."""
    store = DriftStore(spark, frames.scratch(spark))
    orders = frames.table(spark, folder, "orders")

    def compute():
        return drift.drift_report(orders, ORDER_ROLES, YEAR_1995, YEAR_1996)

    store.report("orders", YEAR_1995, YEAR_1996, compute)
    return store, store.report("orders", YEAR_1995, YEAR_1996, compute)


@query(
    "s7_drift_result_store",
    _report_sql("orders", "o_orderdate", ORDER_ROLES, YEAR_1995, YEAR_1996),
)
def drift_result_store(spark, folder):
    return _rounded(_stored(spark, folder)[1])


@query(
    "s8_drift_run_catalogue",
    """SELECT 'orders' AS source, '1995-01-01' AS reference_start, '1996-01-01' AS reference_end,
      '1996-01-01' AS current_start, '1997-01-01' AS current_end
    WHERE EXISTS (SELECT 1 FROM orders)""",
)
def drift_run_catalogue(spark, folder):
    return _stored(spark, folder)[0].catalogue()
