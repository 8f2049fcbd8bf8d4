"""Date expressions that do not depend on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WEEKDAYS = [
    "Monday",
    "Tuesday",
    "Wednesday",
    "Thursday",
    "Friday",
    "Saturday",
    "Sunday",
]


def _col(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def lenient_timestamp(column: Column | str, fmt: str | None = None) -> Column:
    """Timestamp without zone, null where the text is no timestamp."""
    column = _col(column)
    if fmt is None:
        return column.try_cast("timestamp_ntz")
    return F.try_to_timestamp(column, F.lit(fmt)).cast("timestamp_ntz")


def month_start(column: Column | str) -> Column:
    """First day of the month, as timestamp without zone."""
    return F.trunc(_col(column), "MM").cast("timestamp_ntz")


def month_label(column: Column | str) -> Column:
    """``yyyy-MM`` text."""
    return F.substring(F.trunc(_col(column), "MM").cast("string"), 1, 7)


def weekday_number(column: Column | str) -> Column:
    """0 = Monday … 6 = Sunday."""
    return F.weekday(_col(column))


def weekday_name(column: Column | str) -> Column:
    """English day name."""
    names = F.array(*[F.lit(name) for name in WEEKDAYS])
    return F.get(names, weekday_number(column))
