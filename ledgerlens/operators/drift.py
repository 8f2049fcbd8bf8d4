"""Drift between two date ranges: Wasserstein-1 and Jensen–Shannon distances."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace
from datetime import date, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.values import share
from .distribution import ordered_counts
from .joins import attach, broadcast_if_small

Day = date | datetime | str


@dataclass(frozen=True)
class DriftRoles:
    """Which columns to compare, and by which column the data are sliced.

    ``month`` is the partition column of a table stored by month, if there is one.
    """

    timestamp: str
    numeric: list[str] = field(default_factory=list)
    categorical: list[str] = field(default_factory=list)
    month: str | None = None


def as_day(value: Day) -> str:
    """ISO date text of a day."""
    if isinstance(value, datetime):
        value = value.date()
    return value.isoformat() if isinstance(value, date) else str(value)[:10]


def ordered(start: Day, end: Day) -> tuple[str, str]:
    """Bounds as days, swapped if needed."""
    first, second = as_day(start), as_day(end)
    return (first, second) if first <= second else (second, first)


def in_slice(ts: str, start: Day, end: Day, month: str | None = None) -> Column:
    """From ``start`` midnight up to, not including, ``end`` midnight.

    Literals only, so the range reaches the Parquet scan. ``month`` names a
    ``yyyy-MM`` column the table is partitioned by: other months are not even listed.
    """
    first, last = ordered(start, end)
    moment = [F.lit(day + " 00:00:00").cast("timestamp_ntz") for day in (first, last)]
    inside = (F.col(ts) >= moment[0]) & (F.col(ts) < moment[1])
    if month is None:
        return inside
    return inside & F.col(month).between(F.lit(first[:7]), F.lit(last[:7]))


def date_slice(
    df: DataFrame, ts: str, start: Day, end: Day, month: str | None = None
) -> DataFrame:
    return df.filter(in_slice(ts, start, end, month))


def _both_slices(
    df: DataFrame,
    roles: DriftRoles,
    columns: list[str],
    reference: tuple[Day, Day],
    current: tuple[Day, Day],
) -> DataFrame:
    """Rows of either slice with membership flags; slices may overlap."""
    in_reference = in_slice(roles.timestamp, *reference, roles.month)
    in_current = in_slice(roles.timestamp, *current, roles.month)
    return df.filter(in_reference | in_current).select(
        F.coalesce(in_reference, F.lit(False)).alias("_ref"),
        F.coalesce(in_current, F.lit(False)).alias("_cur"),
        *columns,
    )


def wasserstein(
    df: DataFrame,
    roles: DriftRoles,
    reference: tuple[Day, Day],
    current: tuple[Day, Day],
    normed: bool = False,
    min_scale: float = 0.001,
    buckets: int | None = None,
) -> DataFrame:
    """Area between the two distribution functions, per numeric column.

    One scan for all columns. Values are reduced to counts, range-partitioned by column
    and value; prefix sums run within a partition's values of a column, and the totals of
    such cells supply each cell's starting point. ``normed`` divides by the reference's
    standard deviation. An empty slice gives null.
    """
    names = roles.numeric
    rows = _both_slices(
        df,
        roles,
        [F.col(c).cast("double").alias(c) for c in names],
        reference,
        current,
    )
    long = rows.unpivot(["_ref", "_cur"], names, "column_name", "_v").filter(F.col("_v").isNotNull())
    counts = [F.count_if("_ref").alias("_nr"), F.count_if("_cur").alias("_nc")]
    counted = ordered_counts(long, ["column_name"], "_v", counts, buckets)
    # at most one row per column and partition
    cells = counted.groupBy("column_name", "_part").agg(
        F.sum("_nr").alias("_cr"),
        F.sum("_nc").alias("_cc"),
        F.min("_v").alias("_low"),
        F.sum(F.col("_v") * F.col("_nr")).alias("_sum"),
    )
    column = Window.partitionBy("column_name")
    upto = column.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = cells.select(
        "column_name",
        "_part",
        (F.sum("_cr").over(upto) - F.col("_cr")).alias("_sr"),
        (F.sum("_cc").over(upto) - F.col("_cc")).alias("_sc"),
        F.sum("_cr").over(column).alias("_tr"),
        F.sum("_cc").over(column).alias("_tc"),
        F.lead("_low").over(column.orderBy("_part")).alias("_next_low"),
        share(F.sum("_sum").over(column), F.sum("_cr").over(column)).alias("_mean"),
    )
    cell = Window.partitionBy("column_name", "_part").orderBy("_v")
    running = cell.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stepped = attach(counted, broadcast_if_small(starts), ["column_name", "_part"], "inner").select(
        "*",
        F.sum("_nr").over(running).alias("_rr"),
        F.sum("_nc").over(running).alias("_rc"),
        F.lead("_v").over(cell).alias("_next"),
    )
    gap = F.coalesce(F.col("_next"), F.col("_next_low")) - F.col("_v")
    height = F.abs(
        share(F.col("_sr") + F.col("_rr"), F.col("_tr"))
        - share(F.col("_sc") + F.col("_rc"), F.col("_tc"))
    )
    # a single distinct value on both sides has no gap: distance 0 if both exist
    both = (F.max("_tr") > 0) & (F.max("_tc") > 0)
    away = F.col("_v") - F.col("_mean")
    deviation = F.sqrt(F.try_divide(F.sum(away * away * F.col("_nr")), F.max("_tr")))
    distance = F.when(both, F.coalesce(F.sum(height * gap), F.lit(0.0)))
    if normed:
        distance = F.when(F.max("_tr") > 0, F.try_divide(distance, F.greatest(deviation, F.lit(min_scale))))
    return stepped.groupBy("column_name").agg(distance.alias("distance"))


def jensen_shannon(
    df: DataFrame,
    roles: DriftRoles,
    reference: tuple[Day, Day],
    current: tuple[Day, Day],
    base: float = 2.0,
) -> DataFrame:
    """Jensen–Shannon distance of the category shares, per column; ``base`` of the logarithm.

    Nulls are left out. An empty slice gives null.
    """
    names = roles.categorical
    rows = _both_slices(
        df,
        roles,
        [F.col(c).cast("string").alias(c) for c in names],
        reference,
        current,
    )
    long = rows.unpivot(["_ref", "_cur"], names, "column_name", "_v").filter(
        F.col("_v").isNotNull()
    )
    flags = F.count_if("_ref"), F.count_if("_cur")
    counted = long.groupBy("column_name", "_v").agg(
        flags[0].alias("_nr"), flags[1].alias("_nc")
    )
    # one row per compared column
    totals = long.groupBy("column_name").agg(
        flags[0].alias("_tr"), flags[1].alias("_tc")
    )
    joined = counted.join(F.broadcast(totals), "column_name")
    p = share(F.col("_nr"), F.col("_tr"))
    q = share(F.col("_nc"), F.col("_tc"))
    middle = (p + q) / 2

    def term(x: Column) -> Column:
        return F.when(x > 0, x * F.ln(x / middle) / F.lit(math.log(base))).otherwise(0.0)

    both = (F.max("_tr") > 0) & (F.max("_tc") > 0)
    # rounding may push a zero sum just below zero
    divergence = F.greatest(F.sum(term(p) + term(q)) / 2, F.lit(0.0))
    return joined.groupBy("column_name").agg(
        F.when(both, F.sqrt(divergence)).alias("distance")
    )


def drift_report(
    df: DataFrame,
    roles: DriftRoles,
    reference: tuple[Day, Day],
    current: tuple[Day, Day],
    threshold: float = 0.1,
    thresholds: dict[str, float] | None = None,
    normed: bool = True,
    dataset_share: float = 0.5,
    methods: dict[str, str] | None = None,
    base: float = 2.0,
    **options,
) -> DataFrame:
    """One row per column and one for the dataset (share of drifted columns).

    ``methods`` chooses per column: ``wasserstein_normed``, ``wasserstein`` or
    ``jensen_shannon`` (which takes numbers as labels); others are refused. Without a
    choice the kind of the column and ``normed`` decide.
    """
    usual = "wasserstein_normed" if normed else "wasserstein"
    chosen = {**dict.fromkeys(roles.numeric, usual), **dict.fromkeys(roles.categorical, "jensen_shannon")}
    for name, method in (methods or {}).items():
        allowed = ["jensen_shannon"] + ["wasserstein_normed", "wasserstein"] * (name in roles.numeric)
        if name not in chosen or method not in allowed:
            raise ValueError(f"column {name}: method {method}")
        chosen[name] = method
    parts = []
    for method in sorted(set(chosen.values())):
        names = [c for c, m in chosen.items() if m == method]
        if method == "jensen_shannon":
            own = replace(roles, numeric=[], categorical=names)
            found = jensen_shannon(df, own, reference, current, base)
        else:
            own = replace(roles, numeric=names, categorical=[])
            found = wasserstein(df, own, reference, current, method == "wasserstein_normed", **options)
        kind = F.when(F.col("column_name").isin(roles.numeric), "numeric").otherwise("categorical")
        parts.append(found.withColumns({"kind": kind, "method": F.lit(method)}))
    rows = reduce(DataFrame.unionByName, parts)
    limit = F.lit(float(threshold))
    for name, own in (thresholds or {}).items():
        limit = F.when(F.col("column_name") == name, F.lit(float(own))).otherwise(limit)
    columns = rows.select(
        "column_name", "kind", "method", "distance", limit.alias("threshold")
    ).withColumn("drifted", F.coalesce(F.col("distance") >= F.col("threshold"), F.lit(False)))
    drifted = F.avg(F.col("drifted").cast("double"))
    dataset = columns.agg(
        F.lit("(dataset)").alias("column_name"),
        F.lit("dataset").alias("kind"),
        F.lit("share_drifted").alias("method"),
        drifted.alias("distance"),
        F.lit(float(dataset_share)).alias("threshold"),
        (drifted >= dataset_share).alias("drifted"),
    )
    return columns.unionByName(dataset)


def default_windows(df: DataFrame, ts: str) -> DataFrame:
    """Reference: first 26 weeks; comparison: the 26 weeks after."""
    first = F.to_date(F.min(ts))
    return df.agg(
        first.alias("reference_start"),
        F.date_add(first, 26 * 7).alias("reference_end"),
        F.date_add(first, 26 * 7).alias("current_start"),
        F.date_add(first, 52 * 7).alias("current_end"),
    )
