"""Null, rounding and percentage policy shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: exact amounts, for data whose sums outgrow what a double resolves to the cent
MONEY = "decimal(18,2)"


def flag(condition: Column) -> Column:
    """Two-valued condition: a comparison with null is false."""
    return F.coalesce(condition, F.lit(False))


def cents(amount: Column) -> Column:
    """Whole cents as long: two decimals, ties to even.

    Scales by 100 and rounds the double, so doubles round as NumPy rounds them; the
    nearest double of a decimal with two places has the right cents below 2^53. NaN and
    values beyond the long range give null. ``exact_cents`` is for larger decimals.
    """
    return F.rint(amount * F.lit(100)).try_cast("long")


def exact_cents(amount: Column) -> Column:
    """Whole cents of a decimal as long: ties to even, exact at any size."""
    return F.bround(amount * F.lit(100), 0).try_cast("long")


def from_cents(whole: Column) -> Column:
    """Cents → amount as double."""
    return whole / F.lit(100.0)


def off_by(gap_cents: Column, tolerance: float = 0) -> Column:
    """Tolerance test on cents: true beyond the tolerance and for an unknown gap.

    The gap is an integer, so a difference of exactly the tolerance is inside it.
    """
    return gap_cents.isNull() | (F.abs(gap_cents) > F.lit(tolerance * 100 + 1e-6))


def percent(part: Column, whole: Column) -> Column:
    """``part / whole * 100`` as double, null for an empty whole."""
    return F.try_divide(part.cast("double"), whole.cast("double")) * F.lit(100.0)


def share(part: Column, whole: Column) -> Column:
    """``part / whole`` as double, null for an empty whole."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def any_null(columns: list[str]) -> Column:
    """True if at least one of the columns is null."""
    condition = F.lit(False)
    for name in columns:
        condition = condition | F.col(name).isNull()
    return condition


def average(condition: Column) -> Column:
    """Fraction of rows meeting a two-valued condition (aggregate)."""
    return F.avg(F.when(condition, F.lit(1.0)).otherwise(F.lit(0.0)))
