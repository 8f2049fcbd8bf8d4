"""Plausibility rules as boolean columns.

Every rule is true for an error row. One definition serves the row listing, the
count, the share, the monthly trend and the KPI row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import cents, flag, from_cents, off_by

# Words that mark a line as a discount.
DISCOUNT_WORDS = [
    "Rabatt",
    "Skonto",
    "Nachlass",
    "Gutschrift",
    "Bonus",
    "Abzug",
    "Minderung",
    "Gutschein",
    "Erlass",
    "Storno",
    "Kulanz",
]


def contains_word(column: Column, words: list[str]) -> Column:
    """Case-insensitive (Unicode) match of any word; null gives false."""
    text = F.lower(column)
    hits = [text.contains(word.lower()) for word in words]
    return flag(reduce(lambda a, b: a | b, hits))


def sign_is_plausible(agreed: Column, is_discount: Column) -> Column:
    """Discount lines are negative, all others are not; null is not plausible."""
    normal = (agreed >= 0) & ~flag(is_discount)
    discount = (agreed < 0) & flag(is_discount)
    return flag(normal) | flag(discount)


def exceeds(agreed: Column, claimed: Column) -> Column:
    """More agreed than claimed, at cent precision."""
    return cents(agreed) > cents(claimed)


def overshoot_cents(agreed: Column, claimed: Column) -> Column:
    """Size of the excess in whole cents."""
    return cents(agreed - claimed)


def overshoot(agreed: Column, claimed: Column) -> Column:
    """Size of the excess, at cent precision."""
    return from_cents(overshoot_cents(agreed, claimed))


def in_range(amount: Column, low: float = 0.01, high: float = 1) -> Column:
    """Symbolic amount; both ends belong to the range."""
    return amount.between(F.lit(low), F.lit(high))


def at_least(amount: Column, limit: float = 50000) -> Column:
    """Amount so high that it needs a manual look; NaN does not count."""
    return (amount >= F.lit(limit)) & ~F.isnan(amount)


def residual_gap_cents(claimed: Column, agreed: Column, residual: Column) -> Column:
    """Claimed minus agreed, minus the stated residual, in whole cents."""
    return cents(claimed - agreed) - cents(residual)


def residual_gap(claimed: Column, agreed: Column, residual: Column) -> Column:
    """Claimed minus agreed, minus the stated residual."""
    return from_cents(residual_gap_cents(claimed, agreed, residual))


def residual_is_off(
    claimed: Column, agreed: Column, residual: Column, tolerance: float = 0.01
) -> Column:
    """Residual differs by more than the tolerance, or is unknown."""
    return off_by(residual_gap_cents(claimed, agreed, residual), tolerance)


def is_negative(amount: Column) -> Column:
    """Below zero; null and zero are not."""
    return flag(amount < 0)


def odd_sign_out(amounts: list[Column]) -> list[Column]:
    """For three amounts, whose sign stands alone against the other two."""
    signs = [is_negative(amount) for amount in amounts]
    result = []
    for i, own in enumerate(signs):
        others = [sign for j, sign in enumerate(signs) if j != i]
        result.append(reduce(lambda a, b: a & b, [own != sign for sign in others]))
    return result


def signs_differ(left: Column, right: Column) -> Column:
    """Exactly one of the two amounts is negative."""
    return is_negative(left) != is_negative(right)


def name_contains(column: Column, part: str = "test") -> Column:
    """Case-insensitive substring match; null gives false."""
    return contains_word(column, [part])
