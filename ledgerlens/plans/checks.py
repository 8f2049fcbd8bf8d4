"""Queries: rule checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..operators import checks, cleaning, kpi
from . import frames
from .registry import query

_EXCEEDS = f"{frames.cents_sql('agreed')} > {frames.cents_sql('claimed')}"
_EXCESS = frames.cents_sql("agreed - claimed")

OVERSHOOT_SQL = f"""{frames.LINES_SQL},
over AS (SELECT order_id, line_no, claimed, agreed, {_EXCESS} AS cents,
    CAST({_EXCESS} AS DOUBLE) / 100 AS diff
  FROM lines WHERE {_EXCEEDS})"""


def overshoots(spark, folder):
    return checks.overshoot_rows(
        frames.lines(spark, folder), ["order_id", "line_no"], "claimed", "agreed"
    )


@query(
    "r1_agreed_exceeds_claimed",
    f"WITH {OVERSHOOT_SQL} SELECT order_id, line_no, claimed, agreed, diff FROM over",
)
def agreed_exceeds_claimed(spark, folder):
    return overshoots(spark, folder)


@query(
    "r1_agreed_exceeds_claimed_header",
    f"""WITH {frames.HEADER_SQL} SELECT order_id, claimed, agreed,
      CAST({_EXCESS} AS DOUBLE) / 100 AS diff FROM header WHERE {_EXCEEDS}""",
)
def agreed_exceeds_claimed_header(spark, folder):
    return checks.overshoot_rows(
        frames.header(spark, folder), ["order_id"], "claimed", "agreed"
    )


@query(
    "r1_agreed_exceeds_claimed_summary",
    f"""WITH {OVERSHOOT_SQL} SELECT count(*) AS error_count,
      CAST(sum(cents) AS DOUBLE) / 100 / count(*) AS avg_diff FROM over""",
)
def agreed_exceeds_claimed_summary(spark, folder):
    return checks.overshoot_summary(frames.lines(spark, folder), "claimed", "agreed")


@query(
    "r2_pro_forma_receipts",
    "SELECT * FROM orders WHERE o_totalprice BETWEEN 1000 AND 1100",
)
def pro_forma_receipts(spark, folder):
    orders = frames.raw(spark, folder, "orders")
    return checks.rule_rows(orders, rules.in_range(F.col("o_totalprice"), 1000, 1100))


def _summary_sql(table: str, condition: str) -> str:
    return f"""SELECT count(*) FILTER ({condition}) AS error_count, count(*) AS total_rows,
      CAST(count(*) FILTER ({condition}) AS DOUBLE) / count(*) * 100 AS error_pct
    FROM {table}"""


@query(
    "r2_pro_forma_summary",
    _summary_sql("orders", "o_totalprice BETWEEN 1000 AND 1100"),
)
def pro_forma_summary(spark, folder):
    orders = frames.raw(spark, folder, "orders")
    return checks.rule_summary(orders, rules.in_range(F.col("o_totalprice"), 1000, 1100))


@query(
    "r3_high_value",
    """SELECT o_orderkey, o_totalprice, o_custkey, o_orderdate FROM orders
    WHERE o_totalprice >= 490000""",
)
def high_value(spark, folder):
    return checks.rule_rows(
        frames.raw(spark, folder, "orders"),
        rules.at_least(F.col("o_totalprice"), 490000),
        ["o_orderkey", "o_totalprice", "o_custkey", "o_orderdate"],
    )


def _residual_lines(spark, folder):
    late = F.when(F.col("line_no") == 7, 0.02).otherwise(0.0)
    return frames.lines(spark, folder).withColumn("residual", F.col("rebate") + late)


_CENTS = frames.cents_sql
RESIDUAL_SQL = f"""{frames.LINES_SQL},
residual AS (SELECT order_id, line_no, ship_ts, {_CENTS('claimed - net')}
    - {_CENTS('rebate + CASE WHEN line_no = 7 THEN 0.02::DOUBLE ELSE 0.0::DOUBLE END')} AS cents
  FROM lines)"""


@query(
    "r4_residual_check",
    f"""WITH {RESIDUAL_SQL} SELECT order_id, line_no, ship_ts,
      CAST(cents AS DOUBLE) / 100 AS residual_diff
    FROM residual WHERE cents IS NULL OR abs(cents) > 1""",
)
def residual_check(spark, folder):
    return checks.residual_rows(
        _residual_lines(spark, folder),
        ["order_id", "line_no", "ship_ts"],
        "claimed",
        "net",
        "residual",
    )


@query(
    "r4_residual_summary",
    f"WITH {RESIDUAL_SQL} {_summary_sql('residual', 'cents IS NULL OR abs(cents) > 1')}",
)
def residual_summary(spark, folder):
    rule = rules.residual_is_off(F.col("claimed"), F.col("net"), F.col("residual"))
    return checks.rule_summary(_residual_lines(spark, folder), rule)


RESIDUAL_OFF = f"abs({_CENTS('claimed - agreed')} - {_CENTS('residual')}) > 1"

AMOUNTS = ["supplier_balance", "customer_balance", "excess"]
_S, _C, _E = [f"coalesce({a} < 0, false)" for a in AMOUNTS]
_ODD = {
    "supplier_balance": f"({_S} <> {_C} AND {_S} <> {_E})",
    "customer_balance": f"({_C} <> {_S} AND {_C} <> {_E})",
    "excess": f"({_E} <> {_S} AND {_E} <> {_C})",
}


@query(
    "r5_sign_majority_summary",
    f"WITH {frames.SIGNED_SQL} "
    + " UNION ALL ".join(
        f"SELECT '{name}' AS column_name, count(*) FILTER ({odd}) AS error_count FROM signed"
        for name, odd in _ODD.items()
    ),
)
def sign_majority_summary(spark, folder):
    return checks.sign_majority_summary(frames.signed_lines(spark, folder), AMOUNTS)


@query(
    "r6_sign_majority_rows",
    f"""WITH {frames.SIGNED_SQL} SELECT order_id, line_no,
      supplier_balance, customer_balance, excess
    FROM signed WHERE {" OR ".join(_ODD.values())}""",
)
def sign_majority_rows(spark, folder):
    return checks.sign_majority_rows(
        frames.signed_lines(spark, folder), ["order_id", "line_no"], AMOUNTS
    )


_PAIRS = [("supplier_balance", "customer_balance"), ("excess", "customer_balance")]
_PAIR_SQL = {
    "quantity < 0": "coalesce(quantity < 0, false)",
    "quantity_agreed < 0": "coalesce(quantity_agreed < 0, false)",
    "sign supplier_balance <> customer_balance": f"{_S} <> {_C}",
    "sign excess <> customer_balance": f"{_E} <> {_C}",
}


@query(
    "r7_sign_pair_summary",
    f"WITH {frames.SIGNED_SQL} SELECT * FROM ("
    + " UNION ALL ".join(
        f"SELECT '{name}' AS category, count(*) FILTER ({rule}) AS error_count FROM signed"
        for name, rule in _PAIR_SQL.items()
    )
    + ") WHERE error_count > 0",
)
def sign_pair_summary(spark, folder):
    lines = frames.signed_lines(spark, folder)
    found = checks.sign_pair_rules(lines, "quantity", "quantity_agreed", _PAIRS)
    return checks.sign_pair_summary(lines, found)


@query(
    "r8_sign_pair_rows",
    f"""WITH {frames.SIGNED_SQL} SELECT order_id, line_no, part_name, quantity,
      quantity_agreed, supplier_balance, customer_balance, excess
    FROM signed WHERE {" OR ".join(_PAIR_SQL.values())}""",
)
def sign_pair_rows(spark, folder):
    lines = frames.signed_lines(spark, folder)
    found = checks.sign_pair_rules(lines, "quantity", "quantity_agreed", _PAIRS)
    columns = ["line_no", "part_name", "quantity", "quantity_agreed", *AMOUNTS, "unit"]
    return checks.sign_pair_rows(lines, found, "order_id", columns)


@query(
    "r9_discount_logic_error_count",
    f"WITH {frames.SIGNED_SQL} {_summary_sql('flagged', 'NOT is_plausible')}",
)
def discount_logic_errors(spark, folder):
    lines = frames.signed_lines(spark, folder)
    return checks.rule_summary(lines, ~F.col("is_plausible"))


@query(
    "r10_discount_logic_top_texts",
    f"""WITH {frames.SIGNED_SQL} SELECT part_name, count(*) AS occurrences FROM flagged
    WHERE NOT is_plausible AND part_name IS NOT NULL GROUP BY part_name
    ORDER BY occurrences DESC, part_name LIMIT 15""",
)
def discount_logic_top_texts(spark, folder):
    lines = frames.signed_lines(spark, folder)
    return checks.implausible_top(lines, "is_plausible", "part_name")


@query(
    "r11_discount_logic_rows",
    f"""WITH {frames.SIGNED_SQL} SELECT order_id, line_no, part_name,
      customer_balance, is_discount
    FROM flagged WHERE NOT is_plausible""",
)
def discount_logic_rows(spark, folder):
    return checks.implausible_rows(
        frames.signed_lines(spark, folder),
        "is_plausible",
        ["order_id", "line_no", "part_name", "customer_balance", "is_discount", "unit"],
    )


@query(
    "r12_test_data_rows",
    """SELECT c_custkey, c_name, c_mktsegment FROM customer
    WHERE contains(lower(c_mktsegment), 'build')""",
)
def test_data_rows(spark, folder):
    return checks.rule_rows(
        frames.raw(spark, folder, "customer"),
        rules.name_contains(F.col("c_mktsegment"), "build"),
        ["c_custkey", "c_name", "c_mktsegment"],
    )


@query(
    "r12_test_data_summary",
    _summary_sql("customer", "contains(lower(c_mktsegment), 'build')"),
)
def test_data_summary(spark, folder):
    customer = frames.raw(spark, folder, "customer")
    rule = rules.name_contains(F.col("c_mktsegment"), "build")
    return checks.rule_summary(customer, rule)


@query(
    "r13_orders_without_lines",
    """SELECT o_orderkey, o_orderdate, o_orderpriority, o_totalprice FROM orders
    WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_orderkey IS NOT NULL)""",
)
def orders_without_lines(spark, folder):
    lines = frames.raw(spark, folder, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return checks.headers_without_lines(
        frames.table(spark, folder, "orders").select(
            "o_orderkey", "o_orderdate", "o_orderpriority", "o_totalprice"
        ),
        lines,
        "o_orderkey",
    )


RECONCILED_SQL = f"""{frames.HEADER_SQL},
totals AS (SELECT l_orderkey, sum(l_extendedprice) AS total
  FROM lineitem GROUP BY l_orderkey),
gaps AS (SELECT order_id, ts, {_CENTS('claimed - coalesce(total, 0)')} AS claimed_diff,
    {_CENTS('agreed - coalesce(total, 0)')} AS agreed_diff
  FROM header LEFT JOIN totals ON order_id = l_orderkey)"""
_OFF = """claimed_diff IS NULL OR claimed_diff <> 0 OR agreed_diff IS NULL
  OR agreed_diff <> 0"""


def reconciliation(spark, folder):
    totals = checks.line_totals(
        frames.lines(spark, folder), "order_id", "claimed", "claimed"
    )
    return checks.reconciliation_rows(
        frames.header(spark, folder), totals, "order_id", "claimed", "agreed", ["ts"]
    )


@query(
    "r14_header_line_reconciliation",
    f"""WITH {RECONCILED_SQL} SELECT order_id, ts,
      claimed_diff / 100.0::DOUBLE AS claimed_diff, agreed_diff / 100.0::DOUBLE AS agreed_diff
    FROM gaps WHERE {_OFF}""",
)
def header_line_reconciliation(spark, folder):
    return reconciliation(spark, folder)


# Header amounts made from the line sums: equal, within half a cent, beyond it, null.
_AMOUNTS_SQL = f"""sums AS (
  SELECT o_orderkey AS order_id, coalesce(claimed_sum, 0) AS claimed_sum,
    coalesce(agreed_sum, 0) AS agreed_sum
  FROM orders LEFT JOIN (
    SELECT l_orderkey, sum(l_extendedprice) AS claimed_sum,
      sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS agreed_sum
    FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey),
amounts AS (
  SELECT *, claimed_sum + CASE order_id % 4 WHEN 1 THEN 0.004::DOUBLE WHEN 2 THEN 0.02::DOUBLE
      ELSE 0::DOUBLE END AS claimed,
    CASE WHEN order_id % 97 <> 0 THEN agreed_sum + CASE order_id % 5 WHEN 0 THEN 0.004::DOUBLE
      WHEN 1 THEN -5::DOUBLE ELSE 0::DOUBLE END END AS agreed FROM sums),
gaps AS (
  SELECT order_id, {_CENTS("claimed - claimed_sum")} AS claimed_diff,
    {_CENTS("agreed - agreed_sum")} AS agreed_diff FROM amounts)"""
_AMOUNT_ROWS_SQL = f"""WITH {_AMOUNTS_SQL} SELECT order_id,
      claimed_diff / 100.0::DOUBLE AS claimed_diff, agreed_diff / 100.0::DOUBLE AS agreed_diff
    FROM gaps WHERE {_OFF}"""


def made_amounts(spark, folder):
    """Headers with amounts near their line sums, and the line totals."""
    totals = checks.line_totals(frames.lines(spark, folder), "order_id", "claimed", "agreed")
    orders = frames.table(spark, folder, "orders").select(F.col("o_orderkey").alias("order_id"))
    joined = orders.join(totals, "order_id", "left")
    key, zero = F.col("order_id"), F.lit(0.0)
    claimed = F.when(key % 4 == 1, 0.004).when(key % 4 == 2, 0.02).otherwise(0.0)
    agreed = F.when(key % 5 == 0, 0.004).when(key % 5 == 1, -5.0).otherwise(0.0)
    header = joined.select(
        "order_id",
        (F.coalesce("claimed_sum", zero) + claimed).alias("claimed"),
        F.when(key % 97 != 0, F.coalesce("agreed_sum", zero) + agreed).alias("agreed"),
    )
    return header, totals


@query("r14_reconciled_amounts", _AMOUNT_ROWS_SQL)
def reconciled_amounts(spark, folder):
    header, totals = made_amounts(spark, folder)
    return checks.reconciliation_rows(header, totals, "order_id", "claimed", "agreed", [])


@query("r14_narrowed_header", _AMOUNT_ROWS_SQL)
def narrowed_header(spark, folder):
    """The header's key as int, that of the lines as bigint."""
    header, totals = made_amounts(spark, folder)
    narrow = cleaning.narrow_integers(header)
    found = checks.reconciliation_rows(narrow, totals, "order_id", "claimed", "agreed", [])
    return found.withColumn("order_id", F.col("order_id").cast("long"))


_SHARES = {
    "count_pro_forma": ["count_total_orders"],
    "count_high_value": ["count_total_orders"],
    "count_residual_errors": ["count_total_orders"],
    "count_test_rows": ["count_total_orders"],
    "count_overshoot_line": ["count_total_lines"],
    "count_discount_errors": ["count_total_lines"],
    "count_sign_line": ["count_total_orders", "count_total_lines"],
}


@query(
    "r15_shares",
    f"""WITH {frames.SIGNED_SQL},
h AS (SELECT count(*) AS n,
    count(*) FILTER (agreed BETWEEN 1000 AND 1100) AS count_pro_forma,
    count(*) FILTER (agreed >= 490000) AS count_high_value,
    count(*) FILTER ({RESIDUAL_OFF}) AS count_residual_errors,
    count(*) FILTER (contains(lower(segment), 'build')) AS count_test_rows FROM header),
l AS (SELECT count(*) AS n, count(*) FILTER ({_EXCEEDS}) AS count_overshoot_line,
    count(*) FILTER (NOT is_plausible) AS count_discount_errors,
    count(*) FILTER (quantity < 0 OR quantity_agreed < 0 OR {_S} <> {_C}
      OR (claimed < 0) <> (agreed < 0)) AS count_sign_line FROM flagged)
"""
    + " UNION ALL ".join(
        f"""SELECT '{name}_pct' AS share,
      CAST({name} AS DOUBLE) / ({' + '.join({'count_total_orders': 'h.n',
        'count_total_lines': 'l.n'}[w] for w in wholes)}) * 100 AS pct FROM h, l"""
        for name, wholes in _SHARES.items()
    ),
)
def shares(spark, folder):
    header = frames.header(spark, folder).withColumn("line_count", F.lit(1))
    counted = kpi.stack_rows(
        [
            kpi.header_counters(header, frames.HEADER),
            kpi.line_counters(frames.signed_lines(spark, folder), frames.LINE),
        ]
    )
    return checks.shares(counted, _SHARES)
