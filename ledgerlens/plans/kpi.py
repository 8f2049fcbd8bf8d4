"""Queries: KPI row, issue roll-up, comparison, result store."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..operators import cleaning, kpi, timeagg
from ..sources.runs import RunStore
from . import frames
from .checks import _EXCEEDS, _EXCESS, RESIDUAL_OFF
from .registry import query
from .text import NEIGHBOUR_SQL, STATS_SQL, neighbour_mismatches, supplier_types

CUT = "2001-01-01"
NOW, BEFORE = "2026-02", "2026-01"


def counted_header(spark, folder):
    header = frames.clean_header(spark, folder)
    counts = timeagg.line_counts(frames.lines(spark, folder), "order_id", "line_no")
    return cleaning.attach_line_count(header, counts, "order_id")


def header_keys(spark, folder):
    """Key columns of the header, straight from the orders."""
    orders = frames.table(spark, folder, "orders")
    return orders.select(
        F.col("o_orderkey").alias("order_id"), F.col("o_orderstatus").alias("status"),
        F.col("o_orderdate").alias("ts"),
    )


def scalars(spark, folder):
    line_keys = frames.table(spark, folder, "lineitem").select(F.col("l_linenumber").alias("line_no"))
    return kpi.scalar_kpis(
        counted_header(spark, folder), frames.signed_lines(spark, folder), frames.HEADER, frames.LINE,
        header_keys=header_keys(spark, folder), line_keys=line_keys,
    )


def scalars_of_two_runs(spark, folder):
    """(period, metric, value): KPIs of all orders, and of those before the cut, in one pass.

    A line belongs to the period of its order.
    """
    cut = F.lit(CUT).cast("timestamp_ntz")
    header_periods = {NOW: F.lit(True), BEFORE: F.col("ts") < cut}
    line_periods = {NOW: F.lit(True), BEFORE: F.col("_order_ts") < cut}
    dates = header_keys(spark, folder).select("order_id", F.col("ts").alias("_order_ts"))
    line_keys = frames.lines(spark, folder).select("order_id", "line_no").join(dates, "order_id", "left")
    return kpi.scalar_kpis_by_period(
        counted_header(spark, folder),
        frames.signed_lines(spark, folder, "_order_ts"),
        frames.HEADER,
        replace(frames.LINE, not_counted_as_null=["_order_ts"]),
        header_periods,
        line_periods,
        header_keys(spark, folder),
        line_keys,
    )


def _null_pct(columns: list[str]) -> str:
    test = " OR ".join(f"{c} IS NULL" for c in columns)
    return f"avg(CASE WHEN {test} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 100"


_HEADER_COLUMNS = [
    "order_id", "customer_id", "status", "segment", "priority", "claimed",
    "recommended", "agreed", "residual", "balance", "ts",
]
_LINE_COLUMNS = [
    "order_id", "line_no", "part_id", "supplier_id", "quantity", "claimed", "agreed",
    "net", "rebate", "ship_ts", "supplier_balance", "part_name", "part_type",
    "customer_balance", "excess", "quantity_agreed", "is_discount", "is_plausible",
]
_ODD_HEADER = """(claimed < 0) <> (recommended < 0) AND (claimed < 0) <> (agreed < 0)
  OR (recommended < 0) <> (claimed < 0) AND (recommended < 0) <> (agreed < 0)
  OR (agreed < 0) <> (claimed < 0) AND (agreed < 0) <> (recommended < 0)"""


def scalars_sql(where: str = "true", suffix: str = "") -> str:
    """CTEs h, l, u and one-row ``k`` with all KPIs; needs the signed-line CTEs."""
    of_lines = "true" if where == "true" else f"order_id IN (SELECT order_id FROM header WHERE {where})"
    return f"""hc{suffix} AS (
  SELECT header.* REPLACE (nullif(priority, '4-NOT SPECIFIED') AS priority), n AS line_count
  FROM header LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)
    ON order_id = l_orderkey WHERE {where}),
h{suffix} AS (SELECT count(*) AS count_total_orders,
    count(*) FILTER (line_count IS NULL) AS count_empty_orders,
    coalesce({_null_pct(_HEADER_COLUMNS)}, 0) AS null_row_pct_orders,
    count(*) FILTER (contains(lower(segment), 'build')) AS count_test_rows,
    count(*) FILTER ({_EXCEEDS}) AS count_overshoot_header,
    CAST(sum({_EXCESS}) FILTER ({_EXCEEDS}) AS DOUBLE) / 100
      / count(*) FILTER ({_EXCEEDS}) AS avg_overshoot_header,
    count(*) FILTER (agreed BETWEEN 1000 AND 1100) AS count_pro_forma,
    count(*) FILTER (agreed >= 490000) AS count_high_value,
    count(*) FILTER ({RESIDUAL_OFF}) AS count_residual_errors,
    count(*) FILTER ({_ODD_HEADER}) AS count_sign_header FROM hc{suffix}),
l{suffix} AS (SELECT count(*) AS count_total_lines,
    coalesce({_null_pct(_LINE_COLUMNS)}, 0) AS null_row_pct_lines,
    count(*) FILTER ({_EXCEEDS}) AS count_overshoot_line,
    CAST(sum({_EXCESS}) FILTER ({_EXCEEDS}) AS DOUBLE) / 100
      / count(*) FILTER ({_EXCEEDS}) AS avg_overshoot_line,
    count(*) FILTER (NOT is_plausible) AS count_discount_errors,
    count(*) FILTER (quantity < 0 OR quantity_agreed < 0
      OR (supplier_balance < 0) <> (customer_balance < 0)
      OR (claimed < 0) <> (agreed < 0)) AS count_sign_line FROM flagged WHERE {of_lines}),
u{suffix} AS (SELECT
    (SELECT count(*) = count(DISTINCT order_id) FROM hc{suffix}) AS is_unique_order_id,
    (SELECT count(*) = count(DISTINCT line_no) FROM lines WHERE {of_lines}) AS is_unique_line_id,
    (SELECT count(*) = count(DISTINCT (status, order_id)) FROM hc{suffix})
      AS is_unique_number_per_country,
    (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM hc{suffix}
      GROUP BY status, order_id HAVING count(*) > 1)) AS count_duplicate_rows),
k{suffix} AS (SELECT * FROM h{suffix}, l{suffix}, u{suffix})"""


SCALARS_SQL = f"{frames.SIGNED_SQL},\n{scalars_sql()}"
_KPI_LIST = ", ".join(
    f"CAST({m} AS DOUBLE) AS {m}" if not m.startswith("is_") else
    f"CASE WHEN {m} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS {m}"
    for m in kpi.SCALAR_KPIS
)


@query(
    "k1_scalar_kpi_table",
    f"WITH {SCALARS_SQL} SELECT {', '.join(kpi.SCALAR_KPIS)} FROM k",
)
def scalar_kpi_table(spark, folder):
    return kpi.scalar_row(scalars(spark, folder))


def issue_counts(spark, folder):
    from .checks import reconciliation

    outliers = supplier_types(spark, folder).filter("is_outlier")
    return (
        scalars(spark, folder)
        .unionByName(kpi.count_metric(reconciliation(spark, folder), "count_sum_mismatch"))
        .unionByName(kpi.count_metric(outliers, "count_association_outliers"))
        .unionByName(
            kpi.count_metric(neighbour_mismatches(spark, folder), "count_semantic_outliers")
        )
    )


ISSUES_SQL = f"""{SCALARS_SQL}, {STATS_SQL.replace("pairs AS", "st_pairs AS").replace("FROM pairs", "FROM st_pairs")},
{NEIGHBOUR_SQL},
sums AS (SELECT l_orderkey, sum(l_extendedprice) AS total FROM lineitem GROUP BY 1),
extra AS (SELECT
  (SELECT count(*) FROM header LEFT JOIN sums ON order_id = l_orderkey
    WHERE {frames.cents_sql("claimed - coalesce(total, 0)")} <> 0
      OR {frames.cents_sql("agreed - coalesce(total, 0)")} <> 0) AS count_sum_mismatch,
  (SELECT count(*) FROM rated WHERE is_outlier) AS count_association_outliers,
  (SELECT count(*) FROM neighbours WHERE similarity < 0.2) AS count_semantic_outliers)"""


@query(
    "k2_issue_rollup",
    f"""WITH {ISSUES_SQL}, parts AS (SELECT
      count_residual_errors + count_high_value + count_sum_mismatch AS numeric_issues,
      count_test_rows + count_association_outliers + count_semantic_outliers AS text_issues,
      count_overshoot_header + count_overshoot_line + count_discount_errors + count_pro_forma
        + count_sign_header + count_sign_line + count_empty_orders AS plausibility_issues,
      * FROM k, extra)
    SELECT numeric_issues, text_issues, plausibility_issues,
      numeric_issues + text_issues + plausibility_issues + count_duplicate_rows AS overall_issues,
      count_residual_errors, count_high_value, count_association_outliers,
      count_semantic_outliers, count_sum_mismatch, count_overshoot_header,
      count_overshoot_line, count_sign_header, count_sign_line FROM parts""",
)
def issue_rollup(spark, folder):
    return kpi.issue_rollup(issue_counts(spark, folder))


@query(
    "k3_wide_to_long",
    f"WITH {SCALARS_SQL}, wide AS (SELECT {_KPI_LIST} FROM k) "
    + " UNION ALL ".join(
        f"SELECT '{m}' AS metric, coalesce({m}, 0) AS value FROM wide" for m in kpi.SCALAR_KPIS
    ),
)
def wide_to_long(spark, folder):
    return kpi.to_long(kpi.scalar_row(scalars(spark, folder)))


def _long_sql(suffix: str) -> str:
    wide = f"wide{suffix}"
    return f"{wide} AS (SELECT {_KPI_LIST} FROM k{suffix}), long{suffix} AS (" + " UNION ALL ".join(
        f"SELECT '{m}' AS metric, coalesce({m}, 0) AS value FROM {wide}"
        for m in kpi.SCALAR_KPIS
    ) + ")"


COMPARISON_SQL = f"""{frames.SIGNED_SQL},
{scalars_sql()},
{scalars_sql(f"ts < TIMESTAMP '{CUT}'", "_old")},
{_long_sql("")}, {_long_sql("_old")},
changes AS (SELECT long.metric, long.value AS current_value,
    coalesce(long_old.value, 0) AS old_value,
    long.value - coalesce(long_old.value, 0) AS absolute_change
  FROM long LEFT JOIN long_old ON long.metric = long_old.metric),
comparison AS (SELECT *, CASE WHEN old_value <> 0 THEN
      round_even(absolute_change / old_value * 100, 2)
    WHEN current_value = 0 THEN 0 ELSE 100 END AS percent_change FROM changes)"""


def stored_comparison(spark, folder):
    """KPIs of all orders against those of the orders before the cut, from stored rows.

    Both runs' KPI rows come from one pass and are stored; the comparison, and any look
    at a metric, reads the stored rows alone.
    """
    store = RunStore(spark, frames.scratch(spark))
    rows = scalars_of_two_runs(spark, folder).filter(F.col("metric").isin(kpi.SCALAR_KPIS))
    both = store.put("pass", "_kpi_values", rows)
    for run in (BEFORE, NOW):
        store.write(run, {"kpi_values": both.filter(F.col("period") == run).drop("period")})
    return kpi.compare_runs(
        store.read(NOW, "kpi_values"), store.read(store.previous(NOW), "kpi_values")
    )


@query("k4_run_comparison", f"WITH {COMPARISON_SQL} SELECT * FROM comparison")
def run_comparison(spark, folder):
    """In one plan: no row is stored between the KPIs and their comparison."""
    rows = scalars_of_two_runs(spark, folder).filter(F.col("metric").isin(kpi.SCALAR_KPIS))
    value = {run: F.max(F.when(F.col("period") == run, F.col("value"))) for run in (NOW, BEFORE)}
    both = rows.groupBy("metric").agg(value[NOW].alias("value"), value[BEFORE].alias("old"))
    return kpi.with_changes(both.select("metric", F.col("value").alias("current_value"), F.col("old").alias("old_value")))


@query(
    "k5_delta_lookup",
    f"""WITH {COMPARISON_SQL} SELECT metric,
      format('{{:+.2f}}%', percent_change) AS delta
    FROM comparison WHERE metric = 'count_total_orders'""",
)
def delta_lookup(spark, folder):
    return kpi.delta_text(stored_comparison(spark, folder), "count_total_orders")


def _store(spark, folder):
    """Two runs of three result tables: orders before the cut, then all orders."""
    store = RunStore(spark, frames.scratch(spark))
    orders = frames.table(spark, folder, "orders")
    early = orders.filter(F.col("o_orderdate") < F.lit(CUT).cast("timestamp_ntz"))
    for run_id, rows in (("2026-01", early), ("2026-02", orders)):
        store.write(
            run_id,
            {
                "orders": rows,
                "high_value": rows.filter("o_totalprice >= 490000"),
                "monthly": timeagg.rows_by_month(rows, "o_orderdate"),
            },
        )
    return store


_EARLY = f"(SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '{CUT}')"
_COUNTS_SQL = " UNION ALL ".join(
    f"""SELECT '{run}' AS run_id, 'orders' AS table_name, count(*) AS row_count FROM {rows}
    UNION ALL SELECT '{run}', 'high_value', count(*) FROM {rows} WHERE o_totalprice >= 490000
    UNION ALL SELECT '{run}', 'monthly', count(DISTINCT date_trunc('month', o_orderdate))
      FROM {rows}"""
    for run, rows in (("2026-01", _EARLY), ("2026-02", "orders"))
)


@query("s3_named_result_tables", _COUNTS_SQL)
def named_result_tables(spark, folder):
    store = _store(spark, folder)
    parts = [
        store.read(run, name).agg(
            F.lit(run).alias("run_id"),
            F.lit(name).alias("table_name"),
            F.count(F.lit(1)).alias("row_count"),
        )
        for run in ("2026-01", "2026-02")
        for name in ("orders", "high_value", "monthly")
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


@query("s4_read_stored_result", "SELECT * FROM orders WHERE o_totalprice >= 490000")
def read_stored_result(spark, folder):
    return _store(spark, folder).read("2026-02", "high_value")


@query(
    "s4_list_stored_results",
    """SELECT DISTINCT table_name FROM orders,
      (VALUES ('orders'), ('high_value'), ('monthly')) AS t(table_name)""",
)
def list_stored_results(spark, folder):
    return _store(spark, folder).names("2026-02")


@query(
    "s5_snapshot_rotation",
    f"SELECT * FROM {_EARLY} WHERE o_totalprice >= 490000",
)
def snapshot_rotation(spark, folder):
    store = _store(spark, folder)
    return store.read(store.previous("2026-02"), "high_value")


@query(
    "s5_rotation_keeps_two_runs",
    f"""SELECT '2026-02' AS run_id, count(*) AS row_count FROM orders
    UNION ALL SELECT '2026-03', count(*) FROM {_EARLY}""",
)
def rotation_keeps_two_runs(spark, folder):
    """A third run; the first one goes, the others can be read."""
    store = _store(spark, folder)
    third = store.read("2026-01", "orders")
    store.write("2026-03", {"orders": third})
    store.drop_older("2026-03")
    runs = [r["run_id"] for r in store.current_and_previous().collect()]
    counts = [
        store.read(run, "orders").agg(
            F.lit(run).alias("run_id"), F.count(F.lit(1)).alias("row_count")
        )
        for run in runs
    ]
    return counts[0].unionByName(counts[1])
