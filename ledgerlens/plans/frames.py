"""Column roles on the star-schema tables, as DataFrames and as SQL.

Header = orders with their customer, line = line items with part and supplier. Each
DataFrame here has a SQL twin (a CTE) that the reference SQL of the queries uses.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cleaning
from ..operators.joins import local_folder
from ..roles import HeaderRoles, LineRoles
from ..sources.tables import read_raw, read_table

MISSING_PRIORITY = ["4-NOT SPECIFIED"]
PART_WORDS = ["blue", "hot"]

HEADER = HeaderRoles(
    key="order_id",
    number="order_id",
    country="status",
    ts="ts",
    claimed="claimed",
    recommended="recommended",
    agreed="agreed",
    residual="residual",
    group="segment",
    kind="priority",
    trade="priority",
    company="segment",
    test_word="build",
    pro_forma=(1000, 1100),
    high_value=490000,
    not_counted_as_null=["line_count"],
)
LINE = LineRoles(
    key="order_id",
    id="line_no",
    text="part_name",
    claimed="claimed",
    agreed="agreed",
    quantity="quantity",
    quantity_agreed="quantity_agreed",
    unit_price="supplier_balance",
    unit_price_agreed="customer_balance",
)


def table(
    spark: SparkSession, folder: str, name: str, money_columns: list[str] | None = None
) -> DataFrame:
    return read_table(spark, f"{folder}/{name}.parquet", money_columns)


def raw(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return read_raw(spark, f"{folder}/{name}.parquet")


def header(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    customer = table(spark, folder, "customer")
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey, "left")
    late = F.when(F.col("o_orderstatus") == "F", 0.02).otherwise(0.0)
    return joined.select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderstatus").alias("status"),
        F.col("c_mktsegment").alias("segment"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_totalprice").alias("claimed"),
        (F.col("o_totalprice") - 250000).alias("recommended"),
        (F.col("o_totalprice") + F.col("c_acctbal")).alias("agreed"),
        (late - F.col("c_acctbal")).alias("residual"),
        F.col("c_acctbal").alias("balance"),
        F.col("o_orderdate").alias("ts"),
    )


HEADER_SQL = """header AS (
  SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderstatus AS status,
    c_mktsegment AS segment, o_orderpriority AS priority, o_totalprice AS claimed,
    o_totalprice - 250000 AS recommended, o_totalprice + c_acctbal AS agreed,
    CASE WHEN o_orderstatus = 'F' THEN 0.02::DOUBLE ELSE 0.0::DOUBLE END - c_acctbal
      AS residual,
    c_acctbal AS balance, o_orderdate AS ts
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey)"""


def clean_header(spark: SparkSession, folder: str) -> DataFrame:
    """Header with the placeholder priority as null."""
    return cleaning.placeholders_to_null(header(spark, folder), MISSING_PRIORITY)


CLEAN_HEADER_SQL = (
    HEADER_SQL
    + """,
clean AS (SELECT * REPLACE (nullif(priority, '4-NOT SPECIFIED') AS priority) FROM header)"""
)


def clean_orders(spark: SparkSession, folder: str) -> DataFrame:
    return cleaning.placeholders_to_null(table(spark, folder, "orders"), MISSING_PRIORITY)


CLEAN_ORDERS_SQL = """clean AS (
  SELECT * REPLACE (nullif(o_orderpriority, '4-NOT SPECIFIED') AS o_orderpriority)
  FROM orders)"""


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """Line amounts straight from the line items."""
    price, discount = F.col("l_extendedprice"), F.col("l_discount")
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("line_no"),
        F.col("l_partkey").alias("part_id"),
        F.col("l_suppkey").alias("supplier_id"),
        F.col("l_quantity").alias("quantity"),
        price.alias("claimed"),
        (price * (1 - discount) * (1 + F.col("l_tax"))).alias("agreed"),
        (price * (1 - discount)).alias("net"),
        (price * discount).alias("rebate"),
        F.col("l_shipdate").alias("ship_ts"),
    )


LINES_SQL = """lines AS (
  SELECT l_orderkey AS order_id, l_linenumber AS line_no, l_partkey AS part_id,
    l_suppkey AS supplier_id, l_quantity AS quantity, l_extendedprice AS claimed,
    l_extendedprice * (1 - l_discount) * (1 + l_tax) AS agreed,
    l_extendedprice * (1 - l_discount) AS net, l_extendedprice * l_discount AS rebate,
    l_shipdate AS ship_ts
  FROM lineitem)"""


def cents_sql(expression: str) -> str:
    """SQL: amount → whole cents, ties to even."""
    scaled = f"(({expression}) * 100)"
    return (
        f"CAST(CASE WHEN abs({scaled} - trunc({scaled})) = 0.5 "
        f"THEN 2 * round({scaled} / 2) ELSE round({scaled}) END AS BIGINT)"
    )


def signed_lines(spark: SparkSession, folder: str, order_ts: str | None = None) -> DataFrame:
    """Lines with amounts of either sign, their text, and both plausibility flags.

    ``order_ts`` adds the date of the line's order under that name.
    """
    base = lines(spark, folder)
    supplier = table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("supplier_id"),
        F.col("s_acctbal").alias("supplier_balance"),
    )
    part = table(spark, folder, "part").select(
        F.col("p_partkey").alias("part_id"),
        F.col("p_name").alias("part_name"),
        F.col("p_type").alias("part_type"),
    )
    orders = header(spark, folder).select(
        "order_id",
        F.col("balance").alias("customer_balance"),
        F.col("recommended").alias("excess"),
        *([F.col("ts").alias(order_ts)] if order_ts else []),
    )
    joined = (
        base.join(supplier, "supplier_id", "left")
        .join(part, "part_id", "left")
        .join(orders, "order_id", "left")
    )
    shifted = joined.withColumns(
        {
            "quantity_agreed": F.col("quantity") - 3,
            "quantity": F.col("quantity") - 5,
        }
    )
    flagged = cleaning.flag_discounts(shifted, "part_name", PART_WORDS)
    return cleaning.flag_sign_plausibility(flagged, "customer_balance")


SIGNED_SQL = (
    HEADER_SQL
    + ",\n"
    + LINES_SQL
    + """,
signed AS (
  SELECT lines.* REPLACE (quantity - 5 AS quantity), quantity - 3 AS quantity_agreed,
    s_acctbal AS supplier_balance,
    p_name AS part_name, p_type AS part_type,
    balance AS customer_balance,
    recommended AS excess,
    coalesce(regexp_matches(lower(p_name), 'blue|hot'), false) AS is_discount
  FROM lines LEFT JOIN supplier ON supplier_id = s_suppkey
    LEFT JOIN part ON part_id = p_partkey
    LEFT JOIN header ON lines.order_id = header.order_id),
flagged AS (
  SELECT *, coalesce((customer_balance >= 0 AND NOT is_discount)
    OR (customer_balance < 0 AND is_discount), false) AS is_plausible
  FROM signed)"""
)


def scratch(spark: SparkSession) -> str:
    """New folder next to the cluster's shared checkpoints; local only if unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = local_folder("ledgerlens-")
    return os.path.join(base, f"results-{uuid.uuid4().hex}")
