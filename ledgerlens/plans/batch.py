"""Queries: the claims batch run, end to end, on the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import attach, measured_broadcasts
from ..sources.runs import RunStore
from ..sources.tables import read_if_there, write_table
from . import claims, frames
from .registry import query

CUT = "2001-01-01"
RUNS = ["2026-01", "2026-02"]
TRADES = [("1-URGENT", ["customer#1"]), ("2-HIGH", ["customer#2"])]


def _early(ts: str, cut: str):
    """Is the order before the cut? An order without a date is not."""
    return F.coalesce(F.col(ts) < F.lit(cut).cast("timestamp_ntz"), F.lit(False))


def claim_orders(spark: SparkSession, folder: str, cut: str) -> DataFrame:
    """Orders under the names of the claims data model, and ``early``: before the cut."""
    rows = frames.header(spark, folder)
    key = F.col("order_id").cast("string")
    none = F.lit(None).cast("string")
    return rows.select(
        _early("ts", cut).alias("early"),
        F.concat(F.lit("A"), key).alias("Auftrag_ID"),
        F.concat(F.lit("S"), key).alias("Schadensnummer"),
        key.alias("KvaRechnung_ID"),
        F.concat(F.lit("KVR-"), F.lpad(key, 7, "0")).alias("KvaRechnung_Nummer"),
        F.col("claimed").alias("Forderung_Netto"),
        F.col("recommended").alias("Empfehlung_Netto"),
        F.col("agreed").alias("Einigung_Netto"),
        F.when(F.col("status") == "F", 1).otherwise(2).cast("long").alias("DH_ID"),
        F.col("status").alias("Land"),
        *[none.alias(c) for c in ("PLZ_SO", "PLZ_HW", "PLZ_VN", "address1_postalcode")],
        F.col("priority").alias("Schadenart_Name"),
        F.col("status").alias("Falltyp_Name"),
        F.col("priority").alias("Gewerk_Name"),
        F.col("segment").alias("Kundengruppe"),
        F.col("residual").alias("Differenz_vor_Zeitwert_Netto"),
        F.concat(F.lit("Customer#"), F.col("customer_id").cast("string")).alias("Handwerker_Name"),
    )


def claim_positions(spark: SparkSession, folder: str, cut: str) -> DataFrame:
    """Line items of the orders under the names of the claims data model.

    ``early``: the line's order, or one of that key, is before the cut.
    """
    orders = frames.raw(spark, folder, "orders").groupBy(F.col("o_orderkey").alias("order_id"))
    orders = orders.agg(F.bool_or(_early("o_orderdate", cut)).alias("early"))
    part = frames.table(spark, folder, "part").select(
        F.col("p_partkey").alias("part_id"), F.col("p_name").alias("Bezeichnung")
    )
    key = F.col("order_id").cast("string")
    lines = frames.lines(spark, folder).select(
        "order_id", "line_no", "part_id", "quantity", "claimed", "agreed"
    )
    rows = attach(lines, orders, "order_id", "inner").join(part, "part_id", "left")
    return rows.select(
        "early",
        key.alias("KvaRechnung_ID"),
        F.concat(F.lit("KVR-"), F.lpad(key, 7, "0")).alias("KvaRechnung_Nummer"),
        F.concat_ws("-", "order_id", "line_no").alias("Position_ID"),
        F.lit("Stk").alias("Mengeneinheit"),
        (F.col("quantity") - 5).cast("double").alias("Menge"),
        (F.col("quantity") - 3).cast("double").alias("Menge_Einigung"),
        F.try_divide("claimed", "quantity").cast("double").alias("EP"),
        F.try_divide("agreed", "quantity").cast("double").alias("EP_Einigung"),
        F.col("claimed").alias("Forderung_Netto"),
        F.col("agreed").alias("Einigung_Netto"),
        "Bezeichnung",
        F.lit(None).cast("string").alias("Bemerkung"),
    )


def claim_times(spark: SparkSession, folder: str) -> DataFrame:
    """Time table of all orders."""
    key = F.col("order_id").cast("string")
    none = F.lit(None).cast("timestamp_ntz")
    return frames.header(spark, folder).select(
        F.concat(F.lit("A"), key).alias("Auftrag_ID"),
        F.concat(F.lit("S"), key).alias("Schadensnummer"),
        key.alias("KvaRechnung_ID"),
        F.col("ts").cast("timestamp_ntz").alias("CRMEingangszeit"),
        *[none.alias(c) for c in ("Ausgang Vorgang", "Ausgang Order", "Übergabe Abschluss")],
    )


def store_halves(df: DataFrame, path: str) -> None:
    """Rows before the cut and the others as two tables, each there even if it is empty."""
    df.write.partitionBy("early").option("compression", "zstd").parquet(path)
    for half in ("true", "false"):
        if read_if_there(df.sparkSession, f"{path}/early={half}") is None:
            write_table(df.drop("early").limit(0), f"{path}/early={half}")


def both_runs(spark: SparkSession, folder: str) -> RunStore:
    """Two batch runs into a new store: orders before the cut, then all orders.

    The sources are stored once: the first run reads the half before the cut, the second
    both halves.
    """
    root = frames.scratch(spark)
    settings, store = claims.Settings(TRADES), None
    with measured_broadcasts(spark):
        store_halves(claim_orders(spark, folder, CUT), f"{root}/sources/orders")
        store_halves(claim_positions(spark, folder, CUT), f"{root}/sources/positions")
        write_table(claim_times(spark, folder), f"{root}/sources/times")
    for run_id, halves in zip(RUNS, ("early=true", "early=*")):
        sources = {name: f"{root}/sources/{name}/{halves}" for name in ("orders", "positions")}
        sources["times"] = f"{root}/sources/times"
        store = claims.run(spark, sources, f"{root}/store", run_id, settings)
    return store


# Metrics that plain SQL over the base tables gives: stored name → (source, condition).
_METRICS = {
    "count_total_orders": ("o", "true"),
    "count_empty_orders": ("o", "n IS NULL"),
    "count_above_50k": ("o", "agreed >= 50000"),
    "count_proforma_receipts": ("o", "agreed BETWEEN 0.01 AND 1"),
    "count_plausibility_errors_df": ("o", f"{frames.cents_sql('agreed')} > {frames.cents_sql('claimed')}"),
    "count_test_data_rows": ("o", "contains(lower(segment), 'test')"),
    "count_total_positions": ("l", "true"),
    "count_plausibility_errors_df2": ("l", f"{frames.cents_sql('agreed')} > {frames.cents_sql('claimed')}"),
}


def _counts_sql(run: str, where: str) -> str:
    sources = {
        "o": f"""(SELECT header.*, n FROM header LEFT JOIN (SELECT l_orderkey, count(*) AS n
      FROM lineitem GROUP BY 1) ON order_id = l_orderkey WHERE {where})""",
        "l": f"(SELECT * FROM lines WHERE order_id IN (SELECT order_id FROM header WHERE {where}))",
    }
    return " UNION ALL ".join(
        f"""SELECT '{run}' AS run, '{m}' AS metric, CAST(count(*) AS DOUBLE) AS value
    FROM {sources[s]} WHERE {test}"""
        for m, (s, test) in _METRICS.items()
    )


@query(
    "k4_batch_comparison",
    f"""WITH {frames.HEADER_SQL}, {frames.LINES_SQL},
    counts AS ({_counts_sql("new", "true")}
      UNION ALL {_counts_sql("old", f"ts < TIMESTAMP '{CUT}'")}),
    both_runs AS (SELECT metric, max(value) FILTER (run = 'new') AS current_value,
        max(value) FILTER (run = 'old') AS old_value FROM counts GROUP BY metric)
    SELECT metric AS "Metric", current_value AS "Current_Value", old_value AS "Old_Value",
      current_value - old_value AS "Absolute_Change",
      CASE WHEN old_value <> 0 THEN round_even((current_value - old_value) / old_value * 100, 2)
        WHEN current_value = 0 THEN 0 ELSE 100 END AS "Percent_Change"
    FROM both_runs""",
)
def batch_comparison(spark, folder):
    """What the second run says about the first, for the metrics that SQL gives directly."""
    stored = both_runs(spark, folder).read(RUNS[1], "metric_comparison")
    return stored.filter(F.col("Metric").isin(list(_METRICS)))


# Stored tables whose rows plain SQL counts: name → metric with the same condition.
_TABLES = {
    "auftragsdaten": "count_total_orders",
    "positionsdaten": "count_total_positions",
    "metric_above_50k": "count_above_50k",
    "metric_empty_orders_dataframe": "count_empty_orders",
    "metric_plausibility_diffs_auftragsdaten": "count_plausibility_errors_df",
    "metric_plausibility_diffs_positionsdaten": "count_plausibility_errors_df2",
    "metric_proforma": "count_proforma_receipts",
    "metric_test_data_entries": "count_test_data_rows",
}


def table_counts(store: RunStore) -> DataFrame:
    """Row counts of all tables that the runs have committed, by their manifest."""
    listed = [(r["run_id"], r["table_name"]) for r in store.manifest().collect()]  # 30 per run
    counted = [
        store.read(run, name).agg(
            F.lit(run).alias("run_id"), F.lit(name).alias("table_name"),
            F.count(F.lit(1)).alias("row_count"),
        )
        for run, name in sorted(listed)
    ]
    out = counted[0]
    for one in counted[1:]:
        out = out.unionByName(one)
    return out


@query(
    "s3_batch_run_tables",
    f"""WITH {frames.HEADER_SQL}, {frames.LINES_SQL},
    counts AS ({_counts_sql(RUNS[1], "true")}
      UNION ALL {_counts_sql(RUNS[0], f"ts < TIMESTAMP '{CUT}'")}),
    names(table_name, metric) AS (VALUES {", ".join(f"('{t}', '{m}')" for t, m in _TABLES.items())})
    SELECT run AS run_id, table_name, CAST(value AS BIGINT) AS row_count
    FROM names JOIN counts ON names.metric = counts.metric""",
)
def batch_run_tables(spark, folder):
    """Tables of two batch runs, as committed; the test looks at all thirty of a run."""
    counted = table_counts(both_runs(spark, folder))
    return counted.filter(F.col("table_name").isin(list(_TABLES)))
