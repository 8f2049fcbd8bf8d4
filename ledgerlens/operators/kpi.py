"""KPI rows, issue roll-up and run-to-run comparison."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.values import any_null, flag, from_cents, percent, share
from ..roles import HeaderRoles, LineRoles
from .checks import sign_pair_rules


def to_long(row: DataFrame, ids: tuple[str, ...] = ()) -> DataFrame:
    """Rows → (``ids``, metric, value); booleans 1/0, null, NaN or non-numeric 0."""
    metrics = [c for c in row.columns if c not in ids]
    cast = [
        F.coalesce(
            F.nanvl(F.col(c).cast("string").try_cast("double"), F.lit(0.0)), _truth(c)
        ).alias(c)
        for c in metrics
    ]
    return row.select(*ids, *cast).unpivot(list(ids), metrics, "metric", "value")


def _truth(column: str) -> Column:
    """true → 1, anything else → 0."""
    is_true = F.col(column).cast("string") == "true"
    return F.when(is_true, F.lit(1.0)).otherwise(F.lit(0.0))


def to_wide(kpis: DataFrame, metrics: list[str]) -> DataFrame:
    """(metric, value) → one row with the listed metrics as columns."""
    return kpis.agg(
        *[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in metrics]
    )


def stack_rows(rows: list[DataFrame]) -> DataFrame:
    """Several one-row frames as one (metric, value) table."""
    return reduce(DataFrame.unionByName, [to_long(r) for r in rows])


def with_not_run(kpis: DataFrame, metrics: list[str]) -> DataFrame:
    """Null instead of a number for checks that did not run."""
    ran = ~F.col("metric").isin(metrics)
    return kpis.withColumn("value", F.when(ran, F.col("value"))) if metrics else kpis


def _null_row_pct(df: DataFrame, exclude: list[str], within: Column) -> Column:
    checked = [c for c in df.columns if c not in exclude]
    hit = F.when(any_null(checked), F.lit(1.0)).otherwise(F.lit(0.0))
    return F.coalesce(F.avg(F.when(within, hit)) * 100.0, F.lit(0.0))


def _overshoot(claimed: str, agreed: str, within: Column) -> tuple[Column, Column]:
    hit = within & rules.exceeds(F.col(agreed), F.col(claimed))
    total = F.sum(F.when(hit, rules.overshoot_cents(F.col(agreed), F.col(claimed))))
    return F.count_if(hit), share(from_cents(total), F.count_if(hit))


def header_aggregates(header: DataFrame, roles: HeaderRoles, within: Column) -> list[Column]:
    """Scalar header KPIs and issue counts of the rows that meet a condition."""
    errors, mean = _overshoot(roles.claimed, roles.agreed, within)
    amounts = F.col(roles.claimed), F.col(roles.agreed), F.col(roles.residual)
    odd = rules.odd_sign_out([F.col(a) for a in roles.amounts])
    agreed = F.col(roles.agreed)
    counts = {
        "count_empty_orders": F.col(roles.line_count).isNull(),
        "count_test_rows": rules.name_contains(F.col(roles.group), roles.test_word),
        "count_pro_forma": rules.in_range(agreed, *roles.pro_forma),
        "count_high_value": rules.at_least(agreed, roles.high_value),
        "count_residual_errors": rules.residual_is_off(*amounts),
        "count_sign_header": odd[0] | odd[1] | odd[2],
    }
    return [
        F.count_if(within).alias("count_total_orders"),
        _null_row_pct(header, roles.not_counted_as_null, within).alias("null_row_pct_orders"),
        errors.alias("count_overshoot_header"),
        mean.alias("avg_overshoot_header"),
        *[F.count_if(within & hit).alias(name) for name, hit in counts.items()],
    ]


def line_aggregates(lines: DataFrame, roles: LineRoles, within: Column) -> list[Column]:
    """Scalar line KPIs and issue counts of the rows that meet a condition."""
    errors, mean = _overshoot(roles.claimed, roles.agreed, within)
    signs = sign_pair_rules(lines, roles.quantity, roles.quantity_agreed, roles.sign_pairs)
    any_sign = reduce(lambda a, b: a | b, signs.values(), F.lit(False))
    return [
        F.count_if(within).alias("count_total_lines"),
        _null_row_pct(lines, roles.not_counted_as_null, within).alias("null_row_pct_lines"),
        errors.alias("count_overshoot_line"),
        mean.alias("avg_overshoot_line"),
        F.count_if(within & ~flag(F.col(roles.is_plausible))).alias("count_discount_errors"),
        F.count_if(within & any_sign).alias("count_sign_line"),
    ]


def header_counters(header: DataFrame, roles: HeaderRoles) -> DataFrame:
    """All scalar header KPIs and issue counts in one aggregate, one scan."""
    return header.agg(*header_aggregates(header, roles, F.lit(True)))


def line_counters(lines: DataFrame, roles: LineRoles) -> DataFrame:
    """All scalar line KPIs and issue counts in one aggregate, one scan."""
    return lines.agg(*line_aggregates(lines, roles, F.lit(True)))


#: names of periods → condition on the rows of a table
Periods = dict[str, Column]


def _by_period(df: DataFrame, periods: Periods, aggregates) -> DataFrame:
    """(period, one column per aggregate): all periods in one aggregate over the rows."""
    row = df.agg(
        *[F.struct(F.lit(name).alias("period"), *aggregates(F.coalesce(within, F.lit(False)))).alias(f"_{k}")
          for k, (name, within) in enumerate(periods.items())]
    )
    return row.select(F.inline(F.array(*[f"_{k}" for k in range(len(periods))])))


def key_counters(
    df: DataFrame, keys: dict[str, list[str]], periods: Periods, not_null: tuple[str, ...] = ()
) -> DataFrame:
    """(period, and per key whether it is unique and how many rows repeated keys cover).

    All keys of a table are counted in one pass: each row gives one entry per key, and
    entries are counted per period. Nulls count as values, but rows with a null part do
    not count for the keys named in ``not_null``. Columns are called as the keys, and
    ``<key>_repeated``.
    """
    # a key is its number and its parts as columns, so that the shuffled rows are slim
    width = max(map(len, keys.values()))
    part_names, entries = [f"_k{i}" for i in range(width)], []
    for number, (name, columns) in enumerate(keys.items()):
        texts = [F.col(c).cast("string") for c in columns]
        texts += [F.lit(None).cast("string")] * (width - len(columns))
        counts = ~any_null(columns) if name in not_null else F.lit(True)
        parts = [t.alias(p) for t, p in zip(texts, part_names)]
        entries.append(F.struct(F.lit(number).alias("name"), counts.alias("counts"), *parts))
    flags = [F.coalesce(c, F.lit(False)).alias(f"_p{k}") for k, c in enumerate(periods.values())]
    rows = df.select(F.inline(F.array(*entries)), *flags).filter("counts")
    counted = rows.groupBy("name", *part_names).agg(
        *[F.count_if(f"_p{k}").alias(f"_p{k}") for k in range(len(periods))]
    )

    def states(k: int) -> list[Column]:
        out = []
        for number, name in enumerate(keys):
            repeated = (F.col("name") == number) & (F.col(f"_p{k}") > 1)
            total = F.coalesce(F.sum(F.when(repeated, F.col(f"_p{k}"))), F.lit(0))
            out += [(F.count_if(repeated) == 0).alias(name), total.alias(f"{name}_repeated")]
        return out

    row = counted.agg(
        *[F.struct(F.lit(p).alias("period"), *states(k)).alias(f"_{k}") for k, p in enumerate(periods)]
    )
    return row.select(F.inline(F.array(*[f"_{k}" for k in range(len(periods))])))


# The scalar KPIs of a run, in order.
SCALAR_KPIS = [
    "count_total_orders",
    "count_total_lines",
    "count_empty_orders",
    "null_row_pct_orders",
    "null_row_pct_lines",
    "is_unique_order_id",
    "is_unique_number_per_country",
    "is_unique_line_id",
    "count_test_rows",
    "count_overshoot_header",
    "avg_overshoot_header",
    "count_overshoot_line",
    "avg_overshoot_line",
    "count_pro_forma",
    "count_discount_errors",
]


def scalar_kpis(
    header: DataFrame, lines: DataFrame, h: HeaderRoles, ln: LineRoles, **keys: DataFrame
) -> DataFrame:
    """(metric, value) rows of all scalar KPIs and rule counts of one run."""
    every = {"all": F.lit(True)}
    return scalar_kpis_by_period(header, lines, h, ln, every, every, **keys).drop("period")


def scalar_kpis_by_period(
    header: DataFrame,
    lines: DataFrame,
    h: HeaderRoles,
    ln: LineRoles,
    header_periods: Periods,
    line_periods: Periods,
    header_keys: DataFrame | None = None,
    line_keys: DataFrame | None = None,
) -> DataFrame:
    """(period, metric, value): the scalar KPIs of several periods at once.

    Four aggregates, whatever the number of periods: header rows, line rows, keys of
    either. ``header_keys`` and ``line_keys`` are tables with the key columns (and those
    of the conditions) alone, where they can be had without the joins of the others.
    """
    header_rows = _by_period(header, header_periods, lambda w: header_aggregates(header, h, w))
    line_rows = _by_period(lines, line_periods, lambda w: line_aggregates(lines, ln, w))
    order, number, line = "is_unique_order_id", "is_unique_number_per_country", "is_unique_line_id"
    of_header = key_counters(
        header if header_keys is None else header_keys,
        {order: [h.key], number: [h.country, h.number]}, header_periods, (number,),
    ).withColumnRenamed(f"{number}_repeated", DUPLICATES)
    of_lines = key_counters(lines if line_keys is None else line_keys, {line: [ln.id]}, line_periods)
    parts = [
        header_rows, line_rows,
        of_header.select("period", order, number, DUPLICATES), of_lines.select("period", line),
    ]
    return reduce(DataFrame.unionByName, [to_long(p, ("period",)) for p in parts])


def scalar_row(kpis: DataFrame) -> DataFrame:
    """The scalar KPIs as one typed row: counts long, flags boolean, rest double."""
    columns = []
    for name in SCALAR_KPIS:
        if name.startswith("count_"):
            columns.append(F.col(name).cast("long").alias(name))
        elif name.startswith("is_"):
            columns.append((F.col(name) == 1).alias(name))
        else:
            columns.append(F.col(name))
    return to_wide(kpis, SCALAR_KPIS).select(*columns)


def count_metric(df: DataFrame, metric: str) -> DataFrame:
    """Row count of a result as a (metric, value) row."""
    return to_long(df.agg(F.count(F.lit(1)).alias(metric)))


# Which counts make up which issue group.
NUMERIC_ISSUES = ["count_residual_errors", "count_high_value", "count_sum_mismatch"]
TEXT_ISSUES = ["count_test_rows", "count_association_outliers", "count_semantic_outliers"]
PLAUSIBILITY_ISSUES = [
    "count_overshoot_header",
    "count_overshoot_line",
    "count_discount_errors",
    "count_pro_forma",
    "count_sign_header",
    "count_sign_line",
    "count_empty_orders",
]
DUPLICATES = "count_duplicate_rows"


def issue_rollup(counts: DataFrame) -> DataFrame:
    """One row: three issue groups, their total plus duplicates, and the counts.

    A count that is missing from the input is null, "not run", and adds nothing.
    """
    parts = [*NUMERIC_ISSUES, *TEXT_ISSUES, *PLAUSIBILITY_ISSUES, DUPLICATES]
    wide = to_wide(counts, parts)

    def total(names: list[str]) -> Column:
        return reduce(lambda a, b: a + b, [F.coalesce(n, F.lit(0.0)) for n in names])

    kept = [
        "count_residual_errors",
        "count_high_value",
        "count_association_outliers",
        "count_semantic_outliers",
        "count_sum_mismatch",
        "count_overshoot_header",
        "count_overshoot_line",
        "count_sign_header",
        "count_sign_line",
    ]
    return wide.select(
        total(NUMERIC_ISSUES).cast("long").alias("numeric_issues"),
        total(TEXT_ISSUES).cast("long").alias("text_issues"),
        total(PLAUSIBILITY_ISSUES).cast("long").alias("plausibility_issues"),
        total(parts).cast("long").alias("overall_issues"),
        *[F.col(c).cast("long").alias(c) for c in kept],  # null: the check did not run
    )


def compare_runs(current: DataFrame, previous: DataFrame | None) -> DataFrame:
    """Change of each metric against the previous run; missing old metrics are 0.

    Percent: 0 → 0 is 0, 0 → x is 100, else change / old · 100 with two decimals. A
    null value means that the check did not run; its changes are null.
    """
    new = current.select("metric", F.col("value").alias("current_value"))
    if previous is None:
        both = new.withColumn("old_value", F.lit(0.0))
    else:
        old = previous.select("metric", F.struct("value").alias("old"))
        value = F.when(F.col("old").isNull(), 0.0).otherwise(F.col("old.value"))
        both = new.join(old, "metric", "left").withColumn("old_value", value).drop("old")
    return with_changes(both)


def with_changes(both: DataFrame) -> DataFrame:
    """Absolute and percent change of (metric, current_value, old_value), by metric."""
    change = F.col("current_value") - F.col("old_value")
    relative = (
        F.when(F.col("old_value") != 0, F.bround(percent(change, F.col("old_value")), 2))
        .when(F.col("current_value") == 0, 0.0)
        .when(change.isNotNull(), 100.0)
    )
    return both.select(
        "metric",
        "current_value",
        "old_value",
        change.alias("absolute_change"),
        relative.alias("percent_change"),
    ).orderBy("metric")


def delta_text(comparison: DataFrame, metric: str) -> DataFrame:
    """Percent change of one metric as ``+x.xx%``; null if the metric is unknown."""
    hit = F.when(F.col("metric") == metric, F.col("percent_change"))
    change = F.max(hit)
    return comparison.agg(
        F.lit(metric).alias("metric"),
        F.when(change.isNotNull(), F.format_string("%+.2f%%", change)).alias("delta"),
    )
