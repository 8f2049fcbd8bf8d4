"""Monthly aggregates, trends, top-k and range filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.dates import month_label, month_start
from ..functions.values import percent
from .joins import attach


def line_counts(lines: DataFrame, key: str, id_column: str) -> DataFrame:
    """Number of non-null line ids per non-null key."""
    return (
        lines.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.count(id_column).alias("line_count"))
    )


def lines_per_order_by_month(
    header: DataFrame, counts: DataFrame, key: str, ts: str
) -> DataFrame:
    """Per month of the order: mean, sum and number of orders of the line count.

    ``growth_pct`` compares the mean with the previous observed month. The window
    runs over the monthly aggregate only.
    """
    orders = header.filter(F.col(ts).isNotNull()).select(key, ts)
    per_order = attach(orders, counts.select(key, "line_count"), key)
    return own_lines_by_month(per_order, ts, "line_count")


def own_lines_by_month(header: DataFrame, ts: str, line_count: str) -> DataFrame:
    """``lines_per_order_by_month`` for orders that hold their line count already."""
    lines = F.coalesce(line_count, F.lit(0))
    monthly = header.filter(F.col(ts).isNotNull()).groupBy(month_label(ts).alias("period")).agg(
        F.avg(lines).alias("avg_lines"),
        F.sum(lines).alias("total_lines"),
        F.count(F.lit(1)).alias("orders"),
    )
    return with_growth(monthly, "period", "avg_lines")


def with_growth(monthly: DataFrame, period: str, value: str) -> DataFrame:
    """Percent change against the previous observed period; first is null."""
    before = F.lag(value).over(Window.orderBy(period))
    return monthly.withColumn("growth_pct", percent(F.col(value) - before, before))


def month_range(df: DataFrame, column: str, first: object, last: object) -> DataFrame:
    """Keep periods from ``first`` to ``last``, both included."""
    return df.filter(F.col(column).between(F.lit(first), F.lit(last)))


def trend_highlights(monthly: DataFrame, period: str, value: str) -> DataFrame:
    """Last, minimum and maximum period, labelled; Max beats Min beats Last.

    Ties take the earliest period. Each label comes from one aggregate.
    """
    usable = monthly.filter(F.col(value).isNotNull())
    earliest_low = F.min_by(period, F.struct(value, period))
    earliest_high = F.min_by(period, F.struct(-F.col(value), F.col(period)))
    points = usable.agg(
        F.max(period).alias("last"),
        earliest_low.alias("low"),
        earliest_high.alias("high"),
        F.max_by(value, period).alias("last_value"),
        F.min(value).alias("low_value"),
        F.max(value).alias("high_value"),
    ).filter(F.col("last").isNotNull())

    def point(when: str, size: str, label: str, rank: int) -> Column:
        return F.struct(
            F.col(when).alias(period),
            F.col(size).alias(value),
            F.lit(label).alias("label"),
            F.lit(rank).alias("rank"),
        )

    labelled = points.select(
        F.inline(
            F.array(
                point("last", "last_value", "Last", 0),
                point("low", "low_value", "Min", 1),
                point("high", "high_value", "Max", 2),
            )
        )
    )
    return labelled.groupBy(period, value).agg(F.max_by("label", "rank").alias("label"))


def trend_class(monthly: DataFrame, period: str, value: str) -> DataFrame:
    """Change from first to last period, and what to call it.

    Below 2 percent stable, below 8 slight, else strong. Fewer than two periods or
    an unknown or zero start give "too short".
    """
    ends = monthly.agg(
        F.count(F.lit(1)).alias("periods"),
        F.min_by(value, period).alias("first_value"),
        F.max_by(value, period).alias("last_value"),
        F.datediff(
            F.max(F.to_date(F.concat(period, F.lit("-01")))),
            F.min(F.to_date(F.concat(period, F.lit("-01")))),
        ).alias("days"),
    )
    change = F.when(
        F.col("periods") >= 2,
        percent(F.col("last_value") - F.col("first_value"), F.col("first_value")),
    )
    direction = F.when(F.col("change_pct") > 0, F.lit("rise")).otherwise(F.lit("fall"))
    size = F.abs("change_pct")
    return ends.select(
        change.alias("change_pct"),
        F.floor(F.col("days") / 30).alias("months"),
    ).select(
        "change_pct",
        "months",
        F.when(F.col("change_pct").isNull(), F.lit("too short"))
        .when(size < 2, F.lit("stable"))
        .when(size < 8, F.concat(F.lit("slight "), direction))
        .otherwise(F.concat(F.lit("strong "), direction))
        .alias("trend"),
    )


def monthly_incidents(rows: dict[str, DataFrame], ts: str) -> DataFrame:
    """Rows per month and category, over several rules' row listings.

    A listing without the timestamp column contributes nothing.
    """
    parts = [
        df.filter(F.col(ts).isNotNull())
        .groupBy(month_start(ts).alias("month"))
        .agg(F.count(F.lit(1)).alias("incidents"))
        .select("month", "incidents", F.lit(label).alias("category"))
        for label, df in rows.items()
        if ts in df.columns
    ]
    if not parts:
        spark = next(iter(rows.values())).sparkSession
        return spark.createDataFrame(
            [], "month timestamp_ntz, incidents long, category string"
        )
    return reduce(DataFrame.unionByName, parts)


def rule_labels(tests: dict[str, Column]) -> Column:
    """Labels of the rules that flag a row, as an array; an unknown result flags nothing."""
    return F.array_compact(F.array(*[F.when(test, F.lit(label)) for label, test in tests.items()]))


def monthly_rule_incidents(df: DataFrame, tests: dict[str, Column], ts: str) -> DataFrame:
    """Rows per month and category, for any number of rules in one scan of the rows.

    A row counts once for every rule that flags it; rows without a timestamp do not count.
    """
    flagged = df.filter(F.col(ts).isNotNull()).select(
        month_start(ts).alias("month"), F.explode(rule_labels(tests)).alias("category")
    )
    return flagged.groupBy("month", "category").agg(F.count(F.lit(1)).alias("incidents"))


def flagged_rows(
    df: DataFrame,
    tests: dict[str, tuple[Column, list[str]]],
    ts: str,
    first: object,
    last: object,
) -> DataFrame:
    """Rows of a date range once per rule that flags them, in one scan; days included.

    Each rule names the columns that it shows; those of other rules are null in its rows.
    """
    shown: dict[str, list[str]] = {}
    for label, (_, columns) in tests.items():
        for name in columns:
            shown.setdefault(name, []).append(label)
    near = df.filter(F.to_date(ts).between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    labels = rule_labels({label: test for label, (test, _) in tests.items()})
    each = near.select(F.explode(labels).alias("_category"), *shown)
    values = [
        F.col(name) if len(labels) == len(tests)
        else F.when(F.col("_category").isin(labels), F.col(name)).alias(name)
        for name, labels in shown.items()
    ]
    return each.select(F.col("_category").alias("category"), *values)


def filter_categories(
    trend: DataFrame, categories: list[str], first: object, last: object
) -> DataFrame:
    """Chosen categories within a month range."""
    return month_range(trend, "month", first, last).filter(
        F.col("category").isin(categories)
    )


def labelled_rows(
    rows: dict[str, DataFrame], ts: str, first: object, last: object
) -> DataFrame:
    """Raw rows of several rules in a date range, category first; days included."""
    parts = [
        df.filter(F.to_date(ts).between(F.lit(first).cast("date"), F.lit(last).cast("date")))
        .select(F.lit(label).alias("category"), "*")
        for label, df in rows.items()
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def rows_by_month(df: DataFrame, ts: str) -> DataFrame:
    """Row count per month."""
    return (
        df.filter(F.col(ts).isNotNull())
        .groupBy(month_start(ts).alias("month"))
        .agg(F.count(F.lit(1)).alias("occurrences"))
    )


def top_values(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    """Most frequent non-null values; ties by value."""
    return (
        df.filter(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("occurrences"))
        .orderBy(F.desc("occurrences"), column)
        .limit(n)
    )


def top_by_sum(df: DataFrame, group: str, value: str, n: int = 10) -> DataFrame:
    """Groups with the largest sum; ties by group."""
    return (
        df.filter(F.col(group).isNotNull())
        .groupBy(group)
        .agg(F.sum(value).alias("total"))
        .orderBy(F.desc("total"), group)
        .limit(n)
    )


def options(df: DataFrame, column: str) -> DataFrame:
    """Distinct values a filter can offer, null included."""
    return df.select(column).distinct()


def filter_selection(df: DataFrame, column: str, selection: list) -> DataFrame:
    """Rows whose value is selected; an empty selection keeps all."""
    return df.filter(F.col(column).isin(selection)) if selection else df


def time_span(df: DataFrame, ts: str) -> DataFrame:
    """First and last timestamp."""
    return df.agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))


