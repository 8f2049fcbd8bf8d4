"""Queries: load, write, cleaning and enrichment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cleaning, timeagg
from ..sources.runs import RunStore
from ..sources.tables import export_csv, read_raw, write_table
from . import frames
from .registry import query


@query("s1_table_load", "SELECT * FROM orders")
def table_load(spark, folder):
    return frames.table(spark, folder, "orders")


@query("s2_cleaned_table_write", f"WITH {frames.CLEAN_ORDERS_SQL} SELECT * FROM clean")
def cleaned_table_write(spark, folder):
    path = frames.scratch(spark)
    write_table(frames.clean_orders(spark, folder), path)
    return read_raw(spark, path)


@query(
    "s6_csv_export",
    """SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders
    WHERE o_totalprice >= 490000""",
)
def csv_export(spark, folder):
    path = frames.scratch(spark)
    rows = frames.raw(spark, folder, "orders").filter("o_totalprice >= 490000")
    export_csv(rows.select("o_orderkey", "o_totalprice", "o_orderpriority"), path)
    schema = "o_orderkey long, o_totalprice double, o_orderpriority string"
    return spark.read.schema(schema).option("header", True).csv(path)


@query(
    "c1_attach_timestamps",
    """SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice, o_orderdate,
      o_orderpriority, c_name, c_nationkey, c_acctbal, c_mktsegment
    FROM orders LEFT JOIN customer ON o_custkey = c_custkey""",
)
def attach_timestamps(spark, folder):
    customer = frames.table(spark, folder, "customer")
    return cleaning.attach_timestamps(
        frames.table(spark, folder, "orders"),
        customer.withColumnRenamed("c_custkey", "o_custkey"),
        "o_custkey",
    )


@query(
    "c1_attach_timestamps_deduped",
    """SELECT c_custkey, c_name, ts, order_id FROM customer LEFT JOIN (
      SELECT o_custkey, min(o_orderdate) AS ts,
        first(o_orderkey ORDER BY o_orderdate, o_orderkey) AS order_id
      FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey""",
)
def attach_timestamps_deduped(spark, folder):
    times = frames.table(spark, folder, "orders").select(
        F.col("o_custkey").alias("c_custkey"),
        F.col("o_orderdate").alias("ts"),
        F.col("o_orderkey").alias("order_id"),
    )
    customers = frames.table(spark, folder, "customer").select("c_custkey", "c_name")
    return cleaning.attach_timestamps(customers, times, "c_custkey", dedupe_on="ts")


@query(
    "c2_propagate_timestamp_to_lines",
    """SELECT l_orderkey, l_linenumber, l_partkey, o_orderdate
    FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey""",
)
def propagate_timestamp(spark, folder):
    lines = frames.table(spark, folder, "lineitem")
    orders = frames.table(spark, folder, "orders")
    return cleaning.propagate_to_lines(
        lines.select("l_orderkey", "l_linenumber", "l_partkey"),
        orders.withColumnRenamed("o_orderkey", "l_orderkey"),
        "l_orderkey",
        ["o_orderdate"],
    )


@query(
    "c3_attach_line_count",
    """SELECT o_orderkey AS order_id, o_orderdate, CAST(n AS INTEGER) AS line_count
    FROM orders LEFT JOIN (SELECT l_orderkey, count(l_linenumber) AS n FROM lineitem
      GROUP BY l_orderkey) ON o_orderkey = l_orderkey""",
)
def attach_line_count(spark, folder):
    counts = timeagg.line_counts(frames.lines(spark, folder), "order_id", "line_no")
    orders = frames.table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("order_id"), "o_orderdate"
    )
    return cleaning.attach_line_count(orders, counts, "order_id")


@query(
    "c3_attach_line_count_narrowed",
    """SELECT o_orderkey::INTEGER::BIGINT AS order_id, CAST(n AS INTEGER) AS line_count
    FROM orders LEFT JOIN (SELECT l_orderkey, count(l_linenumber) AS n FROM lineitem
      GROUP BY l_orderkey) ON o_orderkey = l_orderkey""",
)
def attach_line_count_narrowed(spark, folder):
    """Narrowed header keys against the keys of the lines as they are."""
    counts = timeagg.line_counts(frames.lines(spark, folder), "order_id", "line_no")
    orders = frames.table(spark, folder, "orders").select(F.col("o_orderkey").alias("order_id"))
    return cleaning.attach_line_count(cleaning.narrow_integers(orders), counts, "order_id")


@query("c4_placeholder_to_null", f"WITH {frames.CLEAN_ORDERS_SQL} SELECT * FROM clean")
def placeholder_to_null(spark, folder):
    return frames.clean_orders(spark, folder)


@query(
    "c5_value_corrections",
    """SELECT * REPLACE (CASE WHEN o_orderstatus = 'F' THEN 'FINAL'
      ELSE o_orderstatus END AS o_orderstatus) FROM orders""",
)
def value_corrections(spark, folder):
    return cleaning.correct_values(frames.table(spark, folder, "orders"), {"F": "FINAL"})


def _typed_totals(df: DataFrame, columns: list[str], total) -> DataFrame:
    """Type and a total per column: the chosen type, and that values survived."""
    types = dict(df.dtypes)
    sums = df.agg(*[total(c).alias(c) for c in columns])
    label = F.lit(None).cast("string")
    for name in columns:
        label = F.when(F.col("column_name") == name, F.lit(types[name])).otherwise(label)
    return sums.unpivot([], columns, "column_name", "total").withColumn("data_type", label)


def _int_type_sql(table: str, column: str) -> str:
    return f"""SELECT '{column}' AS column_name, CAST(sum({column}) AS BIGINT) AS total,
      CASE WHEN min({column}) >= -128 AND max({column}) < 128 THEN 'tinyint'
        WHEN min({column}) >= -32768 AND max({column}) < 32768 THEN 'smallint'
        WHEN min({column}) >= -2147483648 AND max({column}) < 2147483648 THEN 'int'
        ELSE 'bigint' END AS data_type FROM {table}"""


@query(
    "c6_integer_narrowing",
    " UNION ALL ".join(
        [_int_type_sql("lineitem", c) for c in ("l_orderkey", "l_partkey", "l_suppkey")]
    ),
)
def integer_narrowing(spark, folder):
    columns = ["l_orderkey", "l_partkey", "l_suppkey"]
    narrowed = cleaning.narrow_integers(frames.table(spark, folder, "lineitem"), columns)
    return _typed_totals(
        narrowed, columns, lambda c: F.sum(F.col(c).cast("long")).cast("long")
    )


@query(
    "c6_types_across_runs",
    f"""WITH keys AS (SELECT '2026-01' AS run_id, s_suppkey AS key FROM supplier
      UNION ALL SELECT '2026-02', o_orderkey FROM orders),
    widest AS ({_int_type_sql("keys", "key")})
    SELECT run_id, any_value(data_type) AS data_type, count(*) AS row_count,
      CAST(sum(key) AS BIGINT) AS total FROM keys, widest GROUP BY run_id""",
)
def types_across_runs(spark, folder):
    """Two runs with values of different ranges, read as one table in the widest type."""
    store = RunStore(spark, frames.scratch(spark))
    sources = {"2026-01": ("supplier", "s_suppkey"), "2026-02": ("orders", "o_orderkey")}
    for run_id, (table, key) in sources.items():
        keys = frames.table(spark, folder, table).select(F.col(key).alias("key"))
        store.write(run_id, {"keys": cleaning.narrow_integers(keys)})
    return store.read_all("keys").groupBy("run_id").agg(
        F.first(F.typeof("key")).alias("data_type"),
        F.count(F.lit(1)).alias("row_count"),
        F.sum(F.col("key").cast("long")).alias("total"),
    )


def _float_type_sql(column: str, expression: str) -> str:
    near = f"round_even({expression}, 4)"
    return f"""SELECT '{column}' AS column_name,
      CASE WHEN bool_or(abs({expression} - {near}) <= 1e-8 + 1e-5 * abs({near}))
        THEN 'float' ELSE 'double' END AS data_type,
      count({expression}) AS total FROM lineitem"""


@query(
    "c7_float_narrowing",
    _float_type_sql("l_tax", "l_tax") + " UNION ALL " + _float_type_sql("shifted", "l_tax + 0.00005"),
)
def float_narrowing(spark, folder):
    items = frames.table(spark, folder, "lineitem").select(
        "l_tax", (F.col("l_tax") + 0.00005).alias("shifted")
    )
    narrowed = cleaning.narrow_floats(items)
    return _typed_totals(narrowed, ["l_tax", "shifted"], F.count)


@query(
    "c8_category_string_typing",
    """SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey,
      CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderpriority FROM orders""",
)
def category_string_typing(spark, folder):
    orders = frames.table(spark, folder, "orders")
    names = ["o_orderkey", "o_custkey", "o_orderpriority"]
    return cleaning.as_strings(orders.select(*names), names)


@query(
    "c9_keyword_flag",
    """SELECT p_partkey, p_name,
      coalesce(regexp_matches(lower(p_name), 'blue|hot'), false) AS is_discount FROM part""",
)
def keyword_flag(spark, folder):
    part = frames.table(spark, folder, "part").select("p_partkey", "p_name")
    return cleaning.flag_discounts(part, "p_name", ["Blue", "HOT"])


@query(
    "c10_sign_plausibility_flag",
    """SELECT c_custkey, is_discount, coalesce((c_acctbal >= 0 AND NOT is_discount)
        OR (c_acctbal < 0 AND is_discount), false) AS is_plausible
    FROM (SELECT *, c_mktsegment IN ('BUILDING', 'MACHINERY') AS is_discount
      FROM customer)""",
)
def sign_plausibility_flag(spark, folder):
    customer = frames.table(spark, folder, "customer")
    flagged = cleaning.flag_discounts(customer, "c_mktsegment", ["building", "machinery"])
    return cleaning.flag_sign_plausibility(flagged, "c_acctbal").select(
        "c_custkey", "is_discount", "is_plausible"
    )


@query(
    "c11_lenient_timestamp_parse",
    """SELECT o_orderkey, TRY_CAST(t AS TIMESTAMP) AS o_orderdate FROM (
      SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'not a date'
        ELSE CAST(o_orderdate AS VARCHAR) END AS t FROM orders)
    WHERE TRY_CAST(t AS TIMESTAMP) IS NOT NULL""",
)
def lenient_timestamp_parse(spark, folder):
    text = F.when(F.col("o_orderstatus") == "P", F.lit("not a date")).otherwise(
        F.col("o_orderdate").cast("string")
    )
    orders = frames.table(spark, folder, "orders").select(
        "o_orderkey", text.alias("o_orderdate")
    )
    return cleaning.parse_timestamps(orders, "o_orderdate")
