"""Cleaning and enrichment of header, line and time tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import lenient_timestamp
from ..functions.rules import DISCOUNT_WORDS, contains_word, sign_is_plausible
from .joins import attach, not_null

# Texts that stand for a missing value (whole value, case-sensitive).
PLACEHOLDERS = [
    "-",
    "(leer)",
    "(null)",
    "wird vergeben",
    "unbekannter HW",
    "#unbekannter hw",
    "Allgemeine Standardbeschreibungen",
]

# Known typing errors and their corrections (whole value).
CORRECTIONS = {
    "Betriebsunterbrechnung": "Betriebsunterbrechung",
    "Überpannung Heizung": "Überspannung Heizung",
    "Kfz": "KFZ",
    "Schliessanlagen": "Schließanlagen",
}


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def attach_timestamps(
    header: DataFrame, times: DataFrame, key: str, dedupe_on: str | None = None
) -> DataFrame:
    """Left join of the time table; columns the header already has are dropped.

    Duplicate keys of the time table fan out. With ``dedupe_on`` only the row with
    the earliest value of that column is kept per key.
    """
    side = _times(header, times, key, dedupe_on)
    return header.join(side, key, "left") if dedupe_on is None else attach(header, side, key)


def _times(header: DataFrame, times: DataFrame, key: str, dedupe_on: str | None) -> DataFrame:
    """Key and new columns of the time table, all rows or the earliest one of each key."""
    extra = [c for c in times.columns if c not in header.columns and c != key]
    side = times.select(key, *extra)
    if dedupe_on is None:
        return side
    values = F.struct(*extra)
    # nulls sort last: a known time beats an unknown one
    order = F.struct(F.col(dedupe_on).isNull(), F.col(dedupe_on), *extra)
    first = side.groupBy(key).agg(F.min_by(values, order).alias("_first"))
    return first.select(key, "_first.*")


def attach_times_and_count(
    header: DataFrame, times: DataFrame, counts: DataFrame, key: str, name: str,
    dedupe_on: str | None = None,
) -> DataFrame:
    """``attach_timestamps`` and ``attach_line_count`` in one: the header is shuffled once.

    Both slim sides are joined first; the wide header then gets their rows.
    """
    key_type = header.schema[key].dataType
    side = _times(header, times, key, dedupe_on).withColumn(key, F.col(key).cast(key_type))
    both = not_null(side, [key]).join(counts.select(key, name), key, "full")
    return attach_line_count(header, both, key, name)


def propagate_to_lines(
    lines: DataFrame, header: DataFrame, key: str, columns: list[str]
) -> DataFrame:
    """Left join of header columns onto the lines; a hot key of the lines is split."""
    return attach(lines, header.select(key, *columns), key)


def attach_line_count(
    header: DataFrame, counts: DataFrame, key: str, name: str = "line_count"
) -> DataFrame:
    """Left join of a count per key as int; no lines gives null."""
    return attach(header, counts, key).withColumn(name, F.col(name).cast("int"))


def placeholders_to_null(
    df: DataFrame, placeholders: list[str] = PLACEHOLDERS
) -> DataFrame:
    """Null out whole values that stand for "missing", in every text column."""
    changed = {
        name: F.when(~F.col(name).isin(placeholders), F.col(name))
        for name in string_columns(df)
    }
    return df.withColumns(changed) if changed else df


def correct_values(
    df: DataFrame, corrections: dict[str, str] = CORRECTIONS
) -> DataFrame:
    """Whole-value replacement in every text column."""
    names = string_columns(df)
    return df.replace(corrections, subset=names) if names else df


_INT_TYPES = [("byte", 7), ("short", 15), ("int", 31)]


def narrow_integers(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Cast each long column to the smallest integer type that holds its values.

    One aggregate finds all ranges; one row reaches the driver.
    """
    names = columns or [
        f.name for f in df.schema.fields if isinstance(f.dataType, T.LongType)
    ]
    if not names:
        return df
    stats = [F.min(n).alias(f"lo_{n}") for n in names]
    stats += [F.max(n).alias(f"hi_{n}") for n in names]
    row = df.agg(*stats).first()
    casts = {}
    for name in names:
        low, high = row[f"lo_{name}"], row[f"hi_{name}"]
        if low is None:
            continue
        for type_name, bits in _INT_TYPES:
            if -(2**bits) <= low and high < 2**bits:
                casts[name] = F.col(name).cast(type_name)
                break
    return df.withColumns(casts) if casts else df


def narrow_floats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Cast a double column to float if any value has at most four decimals.

    Loses cents on large amounts, so no cleaning preset applies it by default.
    """
    names = columns or [
        f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)
    ]
    if not names:
        return df
    tests = []
    for name in names:
        rounded = F.bround(name, 4)
        near = F.abs(F.col(name) - rounded) <= F.lit(1e-8) + F.lit(1e-5) * F.abs(rounded)
        tests.append(F.bool_or(near).alias(name))
    row = df.agg(*tests).first()
    casts = {n: F.col(n).cast("float") for n in names if row[n]}
    return df.withColumns(casts) if casts else df


def as_strings(df: DataFrame, columns: list[str]) -> DataFrame:
    """Type contract for label columns; Parquet dictionary-encodes them anyway."""
    return df.withColumns({n: F.col(n).cast("string") for n in columns})


def flag_discounts(
    lines: DataFrame,
    text: str,
    words: list[str] = DISCOUNT_WORDS,
    name: str = "is_discount",
) -> DataFrame:
    """Mark lines whose text contains a discount word."""
    return lines.withColumn(name, contains_word(F.col(text), words))


def flag_sign_plausibility(
    lines: DataFrame,
    agreed: str,
    discount_flag: str = "is_discount",
    name: str = "is_plausible",
) -> DataFrame:
    """Mark lines whose sign fits their discount flag."""
    return lines.withColumn(
        name, sign_is_plausible(F.col(agreed), F.col(discount_flag))
    )


def parse_timestamps(
    df: DataFrame, column: str, fmt: str | None = None, drop_invalid: bool = True
) -> DataFrame:
    """Lenient text → timestamp; unparseable rows become null and are dropped."""
    parsed = df.withColumn(column, lenient_timestamp(column, fmt))
    return parsed.filter(F.col(column).isNotNull()) if drop_invalid else parsed
