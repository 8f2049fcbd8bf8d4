"""Column profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .distribution import ordered_counts, quantiles_of


def numeric_profile(
    df: DataFrame, columns: list[str], buckets: int | None = None
) -> DataFrame:
    """Count, mean, std, min, quartiles and max, one row per column.

    Two scans of the profiled columns: one aggregate for all plain figures, and the
    counts of the values that the quartiles are found in.
    """
    values = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    figures = {
        "count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max
    }
    row = values.agg(
        *[
            F.struct(F.lit(c).alias("column_name"), *[f(c).alias(n) for n, f in figures.items()]).alias(f"_{i}")
            for i, c in enumerate(columns)
        ]
    )
    basics = row.select(F.inline(F.array(*[f"_{i}" for i in range(len(columns))])))
    long = values.unpivot([], columns, "column_name", "_v").filter(F.col("_v").isNotNull())
    placed = ordered_counts(long, ["column_name"], "_v", [F.count(F.lit(1)).alias("_n")], buckets)
    quartiles = quantiles_of(placed, ["column_name"], [0.25, 0.5, 0.75]).withColumnsRenamed(
        {"q0": "p25", "q1": "p50", "q2": "p75"}
    )
    # both sides have one row per profiled column
    return basics.join(quartiles, "column_name", "left").select(
        "column_name", "count", "mean", "std", "min", "p25", "p50", "p75", "max"
    )


def distinct_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct values per column as text, null included, in one job."""
    texts = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    return texts.unpivot([], columns, "column_name", "value").distinct()


def value_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Frequency of each non-null value of every column, in one job.

    Most frequent first within a column, ties by value.
    """
    columns = columns or df.columns
    texts = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    return (
        texts.unpivot([], columns, "column_name", "value")
        .filter(F.col("value").isNotNull())
        .groupBy("column_name", "value")
        .agg(F.count(F.lit(1)).alias("occurrences"))
        .orderBy("column_name", F.desc("occurrences"), "value")
    )


def schema_rows(df: DataFrame) -> DataFrame:
    """Column names and types as rows."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema)]
    return df.sparkSession.createDataFrame(
        rows, "position int, column_name string, data_type string"
    )


def schema_profile(df: DataFrame) -> DataFrame:
    """Position, name, type, and non-null and distinct values of every column.

    One scan; distinct values are counted exactly, as texts, combined before the shuffle.
    """
    texts = df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])
    long = texts.unpivot([], df.columns, "column_name", "value")
    counted = long.groupBy("column_name", "value").agg(F.count("value").alias("n"))
    found = counted.groupBy("column_name").agg(
        F.sum("n").alias("non_null"), F.count("value").alias("distinct_values")
    )
    # both sides have one row per column
    joined = schema_rows(df).join(found, "column_name", "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("non_null", "distinct_values")]
    return joined.select("position", "column_name", "data_type", *zero)


def preview(df: DataFrame, order: list[str], n: int = 1000) -> DataFrame:
    """First rows in a defined order."""
    return df.orderBy(*order).limit(n)
