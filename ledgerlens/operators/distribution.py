"""Exact quantiles, outliers and histograms that scale past one task.

Order statistics at any size, without cut points of our own and without sampling rows:

1. equal values are counted, combined map-side, so a frequent value is one row;
2. the counts are range-partitioned by (group, value), and stored with their partition;
3. a cell is what one partition holds of a group; there are at most as many cells as
   groups and partitions together. Running totals over a group's cells are the offsets at
   which its partitions start, and tell which cell holds each wanted rank;
4. only the rows of those cells are ordered, each cell in its own task.

The input is read once. Nothing that grows with the table reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .joins import attach, broadcast_if_small, not_null, pin


def ordered_counts(
    rows: DataFrame, keys: list[str], value: str, counts: list[Column], parts: int | None = None
) -> DataFrame:
    """Counts per (keys, value), range-partitioned in that order, with ``_part``, stored.

    ``parts`` is the number of ranges, by default that of shuffle partitions.
    """
    counted = rows.groupBy(*keys, value).agg(*counts)
    order = [F.col(c) for c in (*keys, value)]
    placed = counted.repartitionByRange(parts, *order) if parts else counted.repartitionByRange(*order)
    return pin(placed.withColumn("_part", F.spark_partition_id()))


def group_quantiles(
    df: DataFrame,
    group: list[str],
    value: str,
    quantiles: list[float],
    buckets: int | None = None,
) -> DataFrame:
    """Linear-interpolated quantiles per group: columns ``q0``, ``q1``, ….

    Rows with a null group or value are left out. An empty ``group`` gives one row
    for the whole table, none if it is empty. ``buckets`` is the number of ranges.
    """
    names = group or ["_all"]
    rows = df if group else df.withColumn("_all", F.lit(0))
    columns = [*names, "_v"]
    base = not_null(rows.withColumn("_v", F.col(value).cast("double")).select(*columns), columns)
    placed = ordered_counts(base, names, "_v", [F.count(F.lit(1)).alias("_n")], buckets)
    return quantiles_of(placed, names, quantiles).select(*group, *[f"q{i}" for i in range(len(quantiles))])


def quantiles_of(placed: DataFrame, names: list[str], quantiles: list[float]) -> DataFrame:
    """Quantiles per group from ``ordered_counts`` with value ``_v`` and count ``_n``."""
    ranks = _wanted_ranks(quantiles)
    sizes = placed.groupBy(*names, "_part").agg(F.sum("_n").alias("_n"))
    sizes = _with_ends(sizes, names, "_part", total=True)
    local = {
        name: F.when(_holds(rank), rank - (F.col("_end") - F.col("_n"))).alias(name)
        for name, rank in ranks.items()
    }
    cells = sizes.select(*names, "_part", "_total", *local.values())
    cells = cells.filter(F.coalesce(*[F.col(name) for name in local]).isNotNull())
    in_cell = attach(placed, broadcast_if_small(cells), [*names, "_part"], "inner")
    values = _with_ends(in_cell, [*names, "_part"], "_v")
    picks = [F.max(F.when(_holds(F.col(n)), F.col("_v"))).alias(n) for n in ranks]
    found = values.groupBy(*names).agg(F.max("_total").alias("_total"), *picks)
    columns = []
    for i, q in enumerate(quantiles):
        position = F.lit(float(q)) * (F.col("_total") - 1)
        low, high = F.col(f"_low{i}"), F.col(f"_high{i}")
        between = low + (high - low) * (position - F.floor(position))
        columns.append(between.alias(f"q{i}"))
    return found.select(*names, *columns)


def _wanted_ranks(quantiles: list[float]) -> dict[str, Column]:
    """The two ranks around each quantile's position among ``_total`` rows."""
    ranks = {}
    for i, q in enumerate(quantiles):
        position = F.lit(float(q)) * (F.col("_total") - 1)
        ranks[f"_low{i}"] = F.floor(position)
        ranks[f"_high{i}"] = F.ceil(position)
    return ranks


def _with_ends(
    counts: DataFrame, names: list[str], order: str, total: bool = False
) -> DataFrame:
    """Running end ``_end`` of the size ``_n`` within ``names``, and the total."""
    part = Window.partitionBy(*names)
    upto = part.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = counts.withColumn("_end", F.sum("_n").over(upto))
    return placed.withColumn("_total", F.sum("_n").over(part)) if total else placed


def _holds(rank: Column) -> Column:
    """Does the row cover the rank (counted from 0)?"""
    return (rank >= F.col("_end") - F.col("_n")) & (rank < F.col("_end"))


def group_outliers(
    df: DataFrame,
    group: str,
    value: str,
    quantile: float = 0.99,
    only: object | None = None,
    **options,
) -> DataFrame:
    """Rows strictly outside the group's central quantile range, all columns kept.

    A quantile below one half is mirrored. Null groups are never outliers.
    """
    # 1 - 0.99 is not 0.01 in floating point; the mirrored quantile is meant exactly
    mirrored = round(1 - quantile, 12)
    low, high = sorted((quantile, mirrored))
    rows = df if only is None else df.filter(F.col(group) == F.lit(only))
    bounds = group_quantiles(rows, [group], value, [low, high], **options)
    side = broadcast_if_small(bounds)
    outside = (F.col(value) > F.col("q1")) | (F.col(value) < F.col("q0"))
    return attach(rows, side, group, "inner").filter(outside).select(*df.columns)


def quantile_value(
    df: DataFrame, value: str, quantile: float, name: str, **options
) -> DataFrame:
    """One row with a quantile of a column; 0 if there are no values."""
    found = group_quantiles(df, [], value, [quantile], **options)
    return found.agg(F.coalesce(F.max("q0"), F.lit(0.0)).alias(name))


def histogram(df: DataFrame, value: str, p95: DataFrame, bins: int = 10) -> DataFrame:
    """Binned counts of values up to 1.5 × P95 (up to 100 if P95 is not positive).

    ``p95`` is a one-row table. Bins are equally wide from the smallest to the
    largest kept value. Limits enter as scalar subqueries.
    """
    top = F.col(p95.columns[0])
    limit = p95.select(F.when(top > 0, top * 1.5).otherwise(100.0)).scalar()
    kept = df.select(F.col(value).cast("double").alias("_v")).filter(
        F.col("_v") <= limit
    )
    ends = kept.agg(F.struct(F.min("_v").alias("low"), F.max("_v").alias("high"))).scalar()
    placed = kept.withColumn("_ends", ends)
    low = F.col("_ends.low")
    width = (F.col("_ends.high") - low) / F.lit(float(bins))
    position = F.coalesce(
        F.try_divide(F.col("_v") - low, width).cast("int"), F.lit(0)
    )
    return placed.groupBy(F.least(position, F.lit(bins - 1)).alias("bin")).agg(
        F.count(F.lit(1)).alias("occurrences"),
        F.min("_v").alias("smallest"),
        F.max("_v").alias("largest"),
    )


def extreme_rows(
    df: DataFrame, value: str, p95: DataFrame, tie_break: list[str], n: int = 10
) -> DataFrame:
    """Largest rows above P95 (of all rows if P95 is not positive)."""
    limit = p95.select(
        F.when(F.col(p95.columns[0]) > 0, F.col(p95.columns[0])).otherwise(
            -float("inf")
        )
    ).scalar()
    return (
        df.filter(F.col(value).cast("double") > limit)
        .orderBy(F.desc(value), *tie_break)
        .limit(n)
    )
