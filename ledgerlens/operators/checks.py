"""Rule checks: a rows form and a summary form of each rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.values import cents, flag, from_cents, off_by, percent, share
from .joins import attach


def rule_rows(
    df: DataFrame, rule: Column, columns: list[str | Column] | None = None
) -> DataFrame:
    """Rows the rule flags."""
    found = df.filter(rule)
    return found.select(*columns) if columns else found


def rule_summary(df: DataFrame, rule: Column) -> DataFrame:
    """Error count and share of the table in percent, one pass."""
    errors, total = F.count_if(rule), F.count(F.lit(1))
    return df.agg(
        errors.alias("error_count"),
        total.alias("total_rows"),
        percent(errors, total).alias("error_pct"),
    )


def overshoot_rows(
    df: DataFrame, id_columns: list[str], claimed: str, agreed: str, *extra: str
) -> DataFrame:
    """Agreed above claimed, with the difference."""
    c, a = F.col(claimed), F.col(agreed)
    return df.filter(rules.exceeds(a, c)).select(
        *id_columns, claimed, agreed, rules.overshoot(a, c).alias("diff"), *extra
    )


def overshoot_summary(df: DataFrame, claimed: str, agreed: str) -> DataFrame:
    """Number of overshoots and their mean size (null if there is none)."""
    c, a = F.col(claimed), F.col(agreed)
    hit = rules.exceeds(a, c)
    total = F.sum(F.when(hit, rules.overshoot_cents(a, c)))
    return df.agg(
        F.count_if(hit).alias("error_count"),
        share(from_cents(total), F.count_if(hit)).alias("avg_diff"),
    )


def residual_rows(
    df: DataFrame,
    id_columns: list[str],
    claimed: str,
    agreed: str,
    residual: str,
    tolerance: float = 0.01,
) -> DataFrame:
    """Rows whose stated residual is not claimed minus agreed."""
    amounts = F.col(claimed), F.col(agreed), F.col(residual)
    return df.filter(rules.residual_is_off(*amounts, tolerance)).select(
        *id_columns, rules.residual_gap(*amounts).alias("residual_diff")
    )


def sign_majority_summary(df: DataFrame, amounts: list[str]) -> DataFrame:
    """Per column, rows where its sign stands alone; always one row per column."""
    odd = rules.odd_sign_out([F.col(a) for a in amounts])
    counts = df.agg(*[F.count_if(o).alias(a) for a, o in zip(amounts, odd)])
    return counts.unpivot([], amounts, "column_name", "error_count")


def sign_majority_rows(
    df: DataFrame, id_columns: list[str], amounts: list[str]
) -> DataFrame:
    odd = rules.odd_sign_out([F.col(a) for a in amounts])
    return df.filter(odd[0] | odd[1] | odd[2]).select(*id_columns, *amounts)


def sign_pair_rules(
    df: DataFrame, quantity: str, quantity_agreed: str, pairs: list[tuple[str, str]]
) -> dict[str, Column]:
    """The line checks whose columns exist, by label."""
    found: dict[str, Column] = {}
    for name in (quantity, quantity_agreed):
        if name in df.columns:
            found[f"{name} < 0"] = rules.is_negative(F.col(name))
    for left, right in pairs:
        if left in df.columns and right in df.columns:
            found[f"sign {left} <> {right}"] = rules.signs_differ(
                F.col(left), F.col(right)
            )
    return found


def sign_pair_summary(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Error count per check; checks without errors are left out."""
    if not checks:
        return df.sparkSession.createDataFrame(
            [], "category string, error_count long"
        )
    labels = list(checks)
    aliases = [f"c{i}" for i in range(len(labels))]
    counts = df.agg(*[F.count_if(checks[k]).alias(a) for k, a in zip(labels, aliases)])
    named = counts.withColumnsRenamed(dict(zip(aliases, labels)))
    return named.unpivot([], [F.col(f"`{k}`") for k in labels], "category", "error_count").filter(
        "error_count > 0"
    )


def sign_pair_rows(
    df: DataFrame, checks: dict[str, Column], id_column: str, columns: list[str]
) -> DataFrame:
    """Rows any check flags, with the listed columns that exist.

    A missing id column is replaced by a generated row number.
    """
    hit = F.lit(False)
    for condition in checks.values():
        hit = hit | condition
    if id_column not in df.columns:
        df = df.withColumn(id_column, F.monotonically_increasing_id())
    present = [c for c in columns if c in df.columns and c != id_column]
    return df.filter(hit).select(id_column, *present)


def implausible_rows(
    df: DataFrame, plausible: str, columns: list[str]
) -> DataFrame:
    """Lines whose plausibility flag is false, with the listed columns that exist."""
    present = [c for c in columns if c in df.columns]
    if plausible not in df.columns:
        return df.select(*present).limit(0)
    return df.filter(~flag(F.col(plausible))).select(*present)


def implausible_top(
    df: DataFrame, plausible: str, text: str, n: int = 15
) -> DataFrame:
    """Most frequent texts among implausible lines; nulls left out, ties by text."""
    return (
        df.filter(~flag(F.col(plausible)) & F.col(text).isNotNull())
        .groupBy(text)
        .agg(F.count(F.lit(1)).alias("occurrences"))
        .orderBy(F.desc("occurrences"), text)
        .limit(n)
    )


def headers_without_lines(
    header: DataFrame, lines: DataFrame, key: str
) -> DataFrame:
    """Header rows whose key no line has.

    The keys are reduced before the shuffle and hot header keys stay splittable.
    """
    keys = lines.select(key).filter(F.col(key).isNotNull()).distinct()
    return attach(header, keys, key, "left_anti")


def line_totals(
    lines: DataFrame, key: str, claimed: str, agreed: str, id_column: str | None = None
) -> DataFrame:
    """Per key: line count and both sums. One aggregate serves every user of it."""
    return (
        lines.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(
            F.count(F.col(id_column) if id_column else F.lit(1)).alias("line_count"),
            F.coalesce(F.sum(claimed), F.lit(0)).alias("claimed_sum"),
            F.coalesce(F.sum(agreed), F.lit(0)).alias("agreed_sum"),
        )
    )


def with_line_gaps(
    header: DataFrame, totals: DataFrame, key: str, claimed: str, agreed: str
) -> DataFrame:
    """Headers with the cents by which their amounts differ from their line sums.

    No lines: sum 0. A null header amount has a null gap, which ``off_by`` calls a difference.
    """
    joined = attach(header, totals.select(key, "claimed_sum", "agreed_sum"), key)
    zero = F.lit(0)
    return joined.withColumns(
        {
            "claimed_gap": cents(F.col(claimed) - F.coalesce("claimed_sum", zero)),
            "agreed_gap": cents(F.col(agreed) - F.coalesce("agreed_sum", zero)),
        }
    ).drop("claimed_sum", "agreed_sum")


def reconciliation_rows(
    header: DataFrame,
    totals: DataFrame,
    key: str,
    claimed: str,
    agreed: str,
    extra: list[str],
) -> DataFrame:
    """Headers whose amounts differ from their line sums (no lines: sum 0).

    A null header amount is a difference.
    """
    slim = header.select(key, claimed, agreed, *extra)
    gaps = with_line_gaps(slim, totals, key, claimed, agreed)
    claimed_gap, agreed_gap = F.col("claimed_gap"), F.col("agreed_gap")
    return gaps.filter(off_by(claimed_gap) | off_by(agreed_gap)).select(
        key,
        from_cents(claimed_gap).alias("claimed_diff"),
        from_cents(agreed_gap).alias("agreed_diff"),
        *extra,
    )


def shares(kpis: DataFrame, parts: dict[str, list[str]]) -> DataFrame:
    """Percent shares over a (metric, value) table.

    ``parts`` maps a metric to the metrics whose sum is its whole, for example one
    table's rows or header plus line rows.
    """
    needed = sorted({m for k, v in parts.items() for m in (k, *v)})
    wide = kpis.agg(
        *[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in needed]
    )
    columns = []
    for part, wholes in parts.items():
        total = F.lit(0.0)
        for whole in wholes:
            total = total + F.col(whole)
        columns.append(percent(F.col(part), total).alias(f"{part}_pct"))
    names = [f"{part}_pct" for part in parts]
    return wide.select(*columns).unpivot([], names, "share", "pct")
