"""Key uniqueness and id format checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import attach, not_null


def _key_counts(df: DataFrame, keys: list[str], drop_null_keys: bool) -> DataFrame:
    rows = not_null(df, keys) if drop_null_keys else df
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))


def uniqueness(
    df: DataFrame, keys: str | list[str], drop_null_keys: bool = False
) -> DataFrame:
    """One row: is the key unique, how many keys repeat, how many rows they cover.

    Nulls count as values (two nulls are a duplicate) unless ``drop_null_keys``.
    """
    keys = [keys] if isinstance(keys, str) else keys
    repeated = F.col("_n") > 1
    return _key_counts(df, keys, drop_null_keys).agg(
        (F.count_if(repeated) == 0).alias("is_unique"),
        F.count_if(repeated).alias("duplicate_keys"),
        F.coalesce(F.sum(F.when(repeated, F.col("_n"))), F.lit(0)).alias(
            "duplicate_rows"
        ),
    )


def duplicate_rows(
    df: DataFrame, keys: list[str], columns: list[str] | None = None
) -> DataFrame:
    """Every row whose key occurs more than once; rows with a null key part never.

    The counts are pre-aggregated and joined back, so no task holds all rows of a
    key.
    """
    rows = not_null(df, keys)
    repeated = _key_counts(df, keys, True).filter("_n > 1").select(*keys)
    return attach(rows.select(*(columns or df.columns)), repeated, keys, "left_semi")


def all_true(checks: list[DataFrame], name: str = "all_unique") -> DataFrame:
    """AND over the ``is_unique`` of several one-row checks."""
    flags = reduce(DataFrame.unionByName, [c.select("is_unique") for c in checks])
    return flags.agg(F.bool_and("is_unique").alias(name))


def _segment(column: str, separator: str, index: int) -> Column:
    return F.get(F.split(column, separator), F.lit(index))


def id_format_violations(
    df: DataFrame,
    column: str,
    length: int = 36,
    segments: tuple[int, ...] = (8, 4, 4, 4, 12),
    separator: str = "-",
) -> DataFrame:
    """Ids of wrong length or with a segment of wrong length.

    One pass; ``bad_length`` and ``bad_segment_<i>`` say what is wrong. A missing
    segment is wrong as well. Null ids are skipped.
    """
    flags = {"bad_length": F.length(column) != length}
    for i, expected in enumerate(segments):
        actual = F.length(_segment(column, separator, i))
        flags[f"bad_segment_{i}"] = F.coalesce(actual != expected, F.lit(True))
    any_bad = reduce(lambda a, b: a | b, flags.values())
    return df.filter(F.col(column).isNotNull() & any_bad).select(
        column, *[flag.alias(name) for name, flag in flags.items()]
    )


def segment_value_counts(df: DataFrame, column: str, separator: str = "-") -> DataFrame:
    """Frequency of each value per segment position."""
    return (
        df.filter(F.col(column).isNotNull())
        .select(F.posexplode(F.split(column, separator)).alias("position", "value"))
        .groupBy("position", "value")
        .agg(F.count(F.lit(1)).alias("occurrences"))
    )
