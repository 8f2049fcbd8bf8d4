"""Batch run over insurance-claim orders, their positions and a time table.

The column and table names of that data model live only here. Each stage reads what
the stage before has stored, so a lost executor costs a task, not the run:

1. positions with timestamp and discount flags → ``positionsdaten``
2. one aggregate per order (count and both sums) → working table
3. orders with timestamps and position count, in one shuffle → ``auftragsdaten``
4. every metric table, from the stored tables (pruned columns, pushed filters)
5. scalar KPIs, issue roll-up from the stored row counts, comparison with the last run
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.dates import month_label
from ..functions.encoders import Encoder
from ..operators import checks, cleaning, completeness, distribution, drift, kpi, profile
from ..operators import text, timeagg
from ..operators import uniqueness as unique
from ..operators.drift import Day, DriftRoles
from ..operators.joins import measured_broadcasts
from ..roles import HeaderRoles, LineRoles
from ..sources.drift_store import DriftStore
from ..sources.runs import RunStore
from ..sources.tables import read_table

KEY = "KvaRechnung_ID"
TS = "CRMEingangszeit"
#: column that stored orders and positions are partitioned by; no metric looks at it
MONTH = "_month"

# Column names of the data model, and which of them drift reports compare.
ORDER = HeaderRoles(
    key=KEY,
    number="KvaRechnung_Nummer",
    country="DH_ID",
    ts=TS,
    claimed="Forderung_Netto",
    recommended="Empfehlung_Netto",
    agreed="Einigung_Netto",
    residual="Differenz_vor_Zeitwert_Netto",
    group="Kundengruppe",
    kind="Schadenart_Name",
    trade="Gewerk_Name",
    company="Handwerker_Name",
    line_count="PositionsAnzahl",
    not_counted_as_null=completeness.HEADER_EXCLUDED,
)
POSITION = LineRoles(
    key=KEY,
    id="Position_ID",
    text="Bezeichnung",
    claimed="Forderung_Netto",
    agreed="Einigung_Netto",
    quantity="Menge",
    quantity_agreed="Menge_Einigung",
    unit_price="EP",
    unit_price_agreed="EP_Einigung",
    is_discount="ist_Abzug",
    is_plausible="Plausibel",
    not_counted_as_null=completeness.LINE_EXCLUDED,
)
ORDER_DRIFT = DriftRoles(
    TS,
    [ORDER.claimed, ORDER.recommended, ORDER.agreed, ORDER.residual],
    ["Land", ORDER.kind, "Falltyp_Name", ORDER.trade],
    MONTH,
)
POSITION_DRIFT = DriftRoles(
    TS,
    ["Menge", "Menge_Einigung", "EP", "EP_Einigung", "Forderung_Netto", "Einigung_Netto"],
    month=MONTH,
)

# Label columns that are text whatever the input says.
ORDER_LABELS = [
    "Land",
    "PLZ_SO",
    "PLZ_HW",
    "PLZ_VN",
    "address1_postalcode",
    "Schadenart_Name",
    "Falltyp_Name",
    "Gewerk_Name",
    "Kundengruppe",
    "Handwerker_Name",
]
POSITION_LABELS = ["KvaRechnung_ID", "KvaRechnung_Nummer", "Mengeneinheit", "Bemerkung"]

# Stored names of the KPIs.
KPI_NAMES = {
    "count_total_lines": "count_total_positions",
    "null_row_pct_orders": "null_row_ratio_orders",
    "null_row_pct_lines": "null_row_ratio_positions",
    "is_unique_order_id": "is_unique_kva_id",
    "is_unique_number_per_country": "is_unique_kva_nr_per_land",
    "is_unique_line_id": "is_unique_position_id",
    "count_test_rows": "count_test_data_rows",
    "count_overshoot_header": "count_plausibility_errors_df",
    "avg_overshoot_header": "avg_plausibility_diff_df",
    "count_overshoot_line": "count_plausibility_errors_df2",
    "avg_overshoot_line": "avg_plausibility_diff_df2",
    "count_pro_forma": "count_proforma_receipts",
    "count_discount_errors": "count_discount_logic_errors",
    "plausibility_issues": "plausi_issues",
    "count_residual_errors": "count_zeitwert_errors",
    "count_high_value": "count_above_50k",
    "count_association_outliers": "count_handwerker_outliers",
    "count_sum_mismatch": "count_abweichung_summen",
    "count_sign_header": "count_false_negative_df",
    "count_sign_line": "count_false_negative_df2",
}
# Stored names of the comparison columns.
COMPARISON_NAMES = {
    "metric": "Metric",
    "current_value": "Current_Value",
    "old_value": "Old_Value",
    "absolute_change": "Absolute_Change",
    "percent_change": "Percent_Change",
}


@dataclass(frozen=True)
class Settings:
    """What a run needs besides the data."""

    keyword_rules: text.Rules | DataFrame
    encoder: Encoder | None = None  # None: the semantic check does not run, its count is null
    time_dedupe: bool = False
    rotate: bool = False  # keep this run and the one before it, drop older ones


def clean_positions(
    positions: DataFrame, dates: DataFrame
) -> DataFrame:
    """Positions with the order's timestamp, nulled placeholders and both flags."""
    dated = cleaning.propagate_to_lines(positions, dates, KEY, [TS])
    tidy = cleaning.as_strings(cleaning.placeholders_to_null(dated), POSITION_LABELS)
    flagged = cleaning.flag_discounts(tidy, POSITION.text, name=POSITION.is_discount)
    return cleaning.flag_sign_plausibility(
        flagged, POSITION.agreed, POSITION.is_discount, POSITION.is_plausible
    )


def time_orders(orders: DataFrame, times: DataFrame, dedupe: bool = False) -> DataFrame:
    """Orders with the timestamps of the time table."""
    return cleaning.attach_timestamps(orders, times, KEY, TS if dedupe else None)


def dates_of(orders: DataFrame, times: DataFrame, dedupe: bool = False) -> DataFrame:
    """Key and timestamp alone of ``time_orders``, which the positions need."""
    slim = [[c for c in (KEY, TS) if c in df.columns] for df in (orders, times)]
    timed = time_orders(orders.select(*slim[0]), times.select(*slim[1]), dedupe)
    return timed.select(KEY, TS)


def clean_orders(
    orders: DataFrame, times: DataFrame, counts: DataFrame, dedupe: bool = False
) -> DataFrame:
    """Orders with timestamps and position count, nulled placeholders, corrected labels."""
    named = counts.withColumnRenamed("line_count", ORDER.line_count)
    counted = cleaning.attach_times_and_count(
        orders, times, named, KEY, ORDER.line_count, TS if dedupe else None
    ).withColumnRenamed("Auftrag_ID", "AuftragID")
    tidy = cleaning.correct_values(cleaning.placeholders_to_null(counted))
    return cleaning.as_strings(tidy, ORDER_LABELS)


def order_metrics(
    orders: DataFrame, totals: DataFrame, settings: Settings
) -> dict[str, DataFrame]:
    """Metric tables over the stored orders, by stored name."""
    # Names of the stored tables and of their columns.
    o = ORDER
    agreed = F.col(o.agreed)
    stats = text.association_stats(orders, o.company, o.trade)
    outliers = text.association_outliers(stats, o.company, o.trade, settings.keyword_rules)
    ratios = completeness.null_ratio_by_column(orders).withColumnRenamed(
        "null_pct", "null_ratio"
    )
    monthly = timeagg.own_lines_by_month(orders, TS, o.line_count)
    grouped = completeness.grouped_null_ratio(orders, o.group)
    signs = checks.sign_majority_rows(orders, [KEY], o.amounts)
    return {
        "metric_null_ratios_per_column": ratios.withColumnRenamed("column_name", "index"),
        "metric_cleanliness_cols_ungrouped_auftragsdaten": ratios,
        "metric_cleanliness_cols_grouped_auftragsdaten": grouped.withColumnsRenamed(
            {f"{c}_ratio": c for c in orders.columns}
        ),
        "metric_cleanliness_rows_grouped_auftragsdaten": completeness.grouped_null_row_ratio(
            orders, o.group
        ).withColumnRenamed("null_row_ratio", "row_null_ratio"),
        "metric_test_data_entries": checks.rule_rows(
            orders, rules.name_contains(F.col(o.group))
        ),
        "metric_plausibility_diffs_auftragsdaten": checks.overshoot_rows(
            orders, [KEY], o.claimed, o.agreed
        ).withColumnRenamed("diff", "Diff"),
        "metric_proforma": checks.rule_rows(orders, rules.in_range(agreed, *o.pro_forma)),
        "metric_above_50k": checks.rule_rows(
            orders,
            rules.at_least(agreed, o.high_value),
            [KEY, o.claimed, o.recommended, o.agreed, o.group, o.company, TS],
        ),
        "metric_zeitwert_errors": checks.residual_rows(
            orders, [KEY, TS], o.claimed, o.agreed, o.residual
        ).withColumnRenamed("residual_diff", "Differenz Zeitwert"),
        "metric_positions_over_time": monthly.withColumnsRenamed(
            {
                "period": "Zeitperiode",
                "avg_lines": "Avg_Positionen_pro_Auftrag",
                "total_lines": "Total_Positionen",
                "orders": "Anzahl_Auftraege",
                "growth_pct": "Growth_rate_%",
            }
        ),
        "metric_error_heatmap": completeness.error_frequency(
            orders, TS, KEY
        ).withColumnRenamed("error_rate_pct", "error_rate"),
        "metric_order_pos_mismatch": checks.reconciliation_rows(
            orders, totals, KEY, o.claimed, o.agreed, [TS]
        ).withColumnsRenamed(
            {"claimed_diff": "Diff_Forderung", "agreed_diff": "Diff_Einigung"}
        ),
        "metric_handwerker_outliers": outliers.withColumnsRenamed(
            {
                "pair_count": "count",
                "trade_count": "anzahl_gewerke",
                "check_result": "Check_Result",
            }
        ),
        "metric_semantic_mismatches": _semantic(orders, settings).withColumnRenamed(
            "similarity", "Similarity_Score"
        ),
        "metric_position_count_positionsdaten": totals.select(
            KEY, F.col("line_count").alias(o.line_count)
        ),
        "metric_empty_orders_dataframe": checks.rule_rows(
            orders, F.col(o.line_count).isNull()
        ),
        "metric_outliers_by_damage": distribution.group_outliers(
            orders, o.kind, o.claimed
        ),
        "metric_fn_stats_df1": checks.sign_majority_summary(
            orders, o.amounts
        ).withColumnsRenamed({"column_name": "Spalte", "error_count": "Fehler"}),
        "metric_fn_details_df1": signs,
    }


def _semantic(orders: DataFrame, settings: Settings) -> DataFrame:
    o = ORDER
    if settings.encoder is None:
        return orders.withColumn("similarity", F.lit(None).cast("double")).limit(0)
    return text.semantic_mismatches(
        orders,
        o.company,
        o.trade,
        text.encode_distinct(orders, o.company, settings.encoder),
        text.encode_distinct(orders, o.trade, settings.encoder),
        ordered=False,
    )


def position_metrics(positions: DataFrame) -> dict[str, DataFrame]:
    """Metric tables over the stored positions, by stored name."""
    # Names of the stored tables and of their columns.
    p = POSITION
    pair_rules = checks.sign_pair_rules(
        positions, p.quantity, p.quantity_agreed, p.sign_pairs
    )
    shown = [p.text, "Menge", "Menge_Einigung", "EP", "EP_Einigung", p.claimed, p.agreed]
    return {
        "metric_cleanliness_cols_ungrouped_positionsdaten": completeness.null_ratio_by_column(
            positions
        ).withColumnRenamed("null_pct", "null_ratio"),
        "metric_plausibility_diffs_positionsdaten": checks.overshoot_rows(
            positions, [p.id], p.claimed, p.agreed
        ).withColumnRenamed("diff", "Diff"),
        "metric_discount_stats": checks.implausible_top(
            positions, p.is_plausible, p.text
        ).withColumnRenamed("occurrences", "Anzahl"),
        "metric_discount_details": checks.implausible_rows(
            positions, p.is_plausible, [p.id, p.text, p.claimed, p.agreed, p.is_discount]
        ),
        "metric_fn_stats_df2": checks.sign_pair_summary(
            positions, pair_rules
        ).withColumnsRenamed({"category": "Kategorie", "error_count": "Anzahl"}),
        "metric_fn_details_df2": checks.sign_pair_rows(positions, pair_rules, p.id, shown),
    }


def run(
    spark: SparkSession,
    sources: dict[str, str],
    out: str,
    run_id: str,
    settings: Settings,
) -> RunStore:
    """One batch run. ``sources`` names the Parquet paths of orders, positions, times."""
    with measured_broadcasts(spark):
        return _run(spark, sources, RunStore(spark, out), run_id, settings)


def _run(
    spark: SparkSession, sources: dict[str, str], store: RunStore, run_id: str, settings: Settings
) -> RunStore:
    raw_orders = read_table(spark, sources["orders"])
    raw_positions = read_table(spark, sources["positions"])
    times = read_table(spark, sources["times"])

    dates = dates_of(raw_orders, times, settings.time_dedupe)
    positions = _by_month(store, run_id, "positionsdaten", clean_positions(raw_positions, dates))
    totals = store.put(
        run_id,
        "_order_totals",
        checks.line_totals(positions, KEY, POSITION.claimed, POSITION.agreed, POSITION.id),
    )
    counts = totals.select(KEY, "line_count")
    complete = clean_orders(
        cleaning.narrow_integers(raw_orders), times, counts, settings.time_dedupe
    )
    orders = _by_month(store, run_id, "auftragsdaten", complete)

    tables = {
        **order_metrics(orders, totals, settings),
        **position_metrics(positions),
    }
    stored = store.put_all(run_id, tables)

    # counts of stored tables come from Parquet footers
    values = kpi.scalar_kpis(orders, positions, ORDER, POSITION)
    counted = {
        "count_sum_mismatch": "metric_order_pos_mismatch",
        "count_association_outliers": "metric_handwerker_outliers",
    }
    if settings.encoder is not None:
        counted["count_semantic_outliers"] = "metric_semantic_mismatches"
    for metric, name in counted.items():
        values = values.unionByName(kpi.count_metric(stored[name], metric))
    values = store.put(run_id, "_kpi_values", values)
    stored["scalar_metrics"] = store.put(
        run_id,
        "scalar_metrics",
        kpi.scalar_row(values).withColumnsRenamed(KPI_NAMES),
    )
    stored["issues"] = store.put(
        run_id, "issues", kpi.issue_rollup(values).withColumnsRenamed(KPI_NAMES)
    )

    previous = store.previous(run_id)
    old = None
    if previous and store.has(previous, "scalar_metrics") and store.has(previous, "issues"):
        old = _long(store.read(previous, "scalar_metrics"), store.read(previous, "issues"))
    now = _long(stored["scalar_metrics"], stored["issues"])
    comparison = kpi.compare_runs(now, old).withColumnsRenamed(COMPARISON_NAMES)
    store.put(run_id, "metric_comparison", comparison)
    store.publish(
        run_id, ["positionsdaten", "auftragsdaten", *stored, "metric_comparison"]
    )
    if settings.rotate:
        store.drop_older(run_id)
    return store


def _by_month(store: RunStore, run_id: str, name: str, df: DataFrame) -> DataFrame:
    """Store a table by month, so that date ranges read their months alone."""
    months = df.withColumn(MONTH, month_label(TS))
    return store.put(run_id, name, months, [MONTH]).drop(MONTH)


def _long(scalars: DataFrame, issues: DataFrame) -> DataFrame:
    """Both KPI rows as (metric, value), each metric once; null means "not run"."""
    new = [c for c in issues.columns if c not in scalars.columns]
    stacked = kpi.stack_rows([scalars, issues.select(*new)])
    row = issues.first()  # one row
    return kpi.with_not_run(stacked, [c for c in new if row[c] is None])


def duplicate_numbers(orders: DataFrame) -> DataFrame:
    """Orders whose number occurs more than once in a country."""
    return unique.duplicate_rows(
        orders, [ORDER.country, ORDER.number], [ORDER.number, ORDER.country]
    )


def follow_up(store: RunStore, run_id: str, rank_by: int = 10) -> dict[str, DataFrame]:
    """What readers look at next, from the stored results of a run; nothing is written.

    Trends and shares of the issue counts, the spread of overshoots, top lists of the
    text checks.
    """
    o = ORDER

    def stored(name: str) -> DataFrame:
        return store.read(run_id, name)

    incidents = timeagg.monthly_incidents(
        {
            "Zeitwert Fehler": stored("metric_zeitwert_errors"),
            "Aufträge > 50k": stored("metric_above_50k"),
            "Abweichung Summen": stored("metric_order_pos_mismatch"),
            "Testdatensätze": stored("metric_test_data_entries"),
        },
        TS,
    )
    monthly = stored("metric_positions_over_time")
    average = "Avg_Positionen_pro_Auftrag"
    outliers = stored("metric_handwerker_outliers")
    mismatches = stored("metric_semantic_mismatches")
    values = _long(stored("scalar_metrics"), stored("issues"))
    both = ["count_total_orders", "count_total_positions"]
    parts = {
        "count_zeitwert_errors": both[:1],
        "count_above_50k": both[:1],
        "count_abweichung_summen": both[:1],
        "count_test_data_rows": both[:1],
        "count_handwerker_outliers": both[:1],
        "count_semantic_outliers": both[:1],
        "count_plausibility_errors_df": both[:1],
        "count_proforma_receipts": both[:1],
        "count_false_negative_df": both[:1],
        "count_plausibility_errors_df2": both[1:],
        "count_discount_logic_errors": both[1:],
        "count_false_negative_df2": both[1:],
        "numeric_issues": both,
        "text_issues": both,
        "plausi_issues": both,
    }
    tables = {
        "incidents_by_month": incidents,
        "shares": checks.shares(values, parts),
        "trend_highlights": timeagg.trend_highlights(monthly, "Zeitperiode", average),
        "trend_class": timeagg.trend_class(monthly, "Zeitperiode", average),
        "proforma_by_month": timeagg.rows_by_month(stored("metric_proforma"), TS),
        "outlier_trades": timeagg.top_values(outliers, o.trade, rank_by),
        "outlier_companies": timeagg.top_by_sum(outliers, o.company, "count", rank_by),
        "mismatch_trades": timeagg.top_values(mismatches, o.trade, rank_by),
        "mismatch_companies": timeagg.top_values(mismatches, o.company, rank_by),
        "kinds_without_positions": timeagg.options(
            stored("metric_empty_orders_dataframe"), o.kind
        ),
        "groups_with_outliers": timeagg.options(stored("metric_outliers_by_damage"), o.group),
    }
    for name, id_column in (("auftragsdaten", KEY), ("positionsdaten", POSITION.id)):
        diffs = stored(f"metric_plausibility_diffs_{name}")
        p95 = distribution.quantile_value(diffs, "Diff", 0.95, "p95")
        tables[f"diff_p95_{name}"] = p95
        tables[f"diff_histogram_{name}"] = distribution.histogram(diffs, "Diff", p95)
        tables[f"diff_extremes_{name}"] = distribution.extreme_rows(
            diffs, "Diff", p95, [id_column], rank_by
        )
    return tables


def profiles(orders: DataFrame, positions: DataFrame) -> dict[str, DataFrame]:
    """Column profiles and id format checks of the stored tables; nothing is written."""
    tables: dict[str, DataFrame] = {}
    for name, df, numeric, labels, id_columns in (
        (
            "auftragsdaten",
            orders,
            ORDER_DRIFT.numeric,
            ["DH_ID", "Land", "Schadenart_Name", "Falltyp_Name", "Gewerk_Name", "Kundengruppe"],
            ["AuftragID", KEY],
        ),
        (
            "positionsdaten",
            positions,
            POSITION_DRIFT.numeric,
            ["Mengeneinheit", "Menge", "Menge_Einigung", "Bemerkung"],
            [KEY, POSITION.id],
        ),
    ):
        tables[f"numeric_{name}"] = profile.numeric_profile(df, numeric)
        tables[f"distinct_{name}"] = profile.distinct_values(df, labels)
        tables[f"counts_{name}"] = profile.value_counts(df)
        tables[f"schema_{name}"] = profile.schema_rows(df)
        tables[f"preview_{name}"] = profile.preview(df, [id_columns[-1]])
        for column in id_columns:
            tables[f"id_format_{name}_{column}"] = unique.id_format_violations(df, column)
            tables[f"id_segments_{name}_{column}"] = unique.segment_value_counts(df, column)
    return tables


def drift_report(
    store: RunStore,
    run_id: str,
    reports: DriftStore,
    positions: bool = False,
    reference: tuple[Day, Day] | None = None,
    current: tuple[Day, Day] | None = None,
    refresh: bool = False,
    **options,
) -> DataFrame:
    """Stored or new drift report of orders or positions.

    Without date ranges the first half year of the orders is compared with the second.
    """
    name = "positionsdaten" if positions else "auftragsdaten"
    roles = POSITION_DRIFT if positions else ORDER_DRIFT
    if reference is None or current is None:
        row = drift.default_windows(store.read(run_id, "auftragsdaten"), TS).first()
        reference = reference or (row["reference_start"], row["reference_end"])
        current = current or (row["current_start"], row["current_end"])
    return reports.report(
        "positions" if positions else "orders",
        reference,
        current,
        lambda: drift.drift_report(
            store.read(run_id, name), roles, reference, current, **options
        ),
        refresh,
    )
