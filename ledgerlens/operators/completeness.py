"""Row counts, null ratios and error frequency by time slot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import weekday_name, weekday_number
from ..functions.values import any_null, average, percent

# Columns the row ratio leaves out by default.
HEADER_EXCLUDED = ["PLZ_SO", "PLZ_HW", "PLZ_VN", "address1_postalcode"]
LINE_EXCLUDED = ["Bemerkung"]


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("row_count"))


def null_ratio_by_column(df: DataFrame) -> DataFrame:
    """Percent of nulls per column, two decimals, one row per column."""
    ratios = df.agg(
        *[
            F.bround(percent(F.count_if(F.col(c).isNull()), F.count(F.lit(1))), 2).alias(c)
            for c in df.columns
        ]
    )
    return ratios.unpivot([], df.columns, "column_name", "null_pct")


def null_row_ratio(df: DataFrame, exclude: list[str] | None = None) -> DataFrame:
    """Percent of rows with at least one null; 0 for an empty table."""
    checked = [c for c in df.columns if c not in (exclude or [])]
    return df.agg(
        F.coalesce(average(any_null(checked)) * 100.0, F.lit(0.0)).alias("null_row_pct")
    )


def _one_group(df: DataFrame, group: str, only: object | None) -> DataFrame:
    kept = df.filter(F.col(group).isNotNull())
    return kept if only is None else kept.filter(F.col(group) == F.lit(only))


def grouped_null_ratio(df: DataFrame, group: str, only: object | None = None) -> DataFrame:
    """Fraction of nulls per column and group (wide); null groups are left out."""
    columns = [c for c in df.columns if c != group]
    return (
        _one_group(df, group, only)
        .groupBy(group)
        .agg(*[average(F.col(c).isNull()).alias(f"{c}_ratio") for c in columns])
    )


def grouped_null_row_ratio(
    df: DataFrame, group: str, only: object | None = None
) -> DataFrame:
    """Fraction of rows with at least one null, per group."""
    columns = [c for c in df.columns if c != group]
    return (
        _one_group(df, group, only)
        .groupBy(group)
        .agg(average(any_null(columns)).alias("null_row_ratio"))
    )


def top_null_columns(ratios: DataFrame, n: int = 10) -> DataFrame:
    """Columns with the highest null percentage; ties by name."""
    return (
        ratios.filter(F.col("null_pct").isNotNull())
        .orderBy(F.desc("null_pct"), "column_name")
        .limit(n)
    )


def error_frequency(
    df: DataFrame, ts: str, id_column: str, relevant: list[str] | None = None
) -> DataFrame:
    """Rows with a null in a relevant column, per weekday and hour.

    Monday first. Without ``relevant`` every column but ``ts`` and ``id_column``
    counts.
    """
    if relevant is None:
        relevant = [c for c in df.columns if c not in (ts, id_column)]
    if not relevant:
        raise ValueError("no columns left to check for nulls")
    slots = (
        df.filter(F.col(ts).isNotNull())
        .groupBy(
            weekday_number(ts).alias("_day"),
            weekday_name(ts).alias("weekday"),
            F.hour(ts).alias("hour"),
        )
        .agg(
            F.count(id_column).alias("total_rows"),
            F.count_if(any_null(relevant)).alias("error_rows"),
        )
    )
    return slots.orderBy("_day", "hour").select(
        "weekday",
        "hour",
        "total_rows",
        "error_rows",
        percent(F.col("error_rows"), F.col("total_rows")).alias("error_rate_pct"),
    )


