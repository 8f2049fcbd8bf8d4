"""Table load and write."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import MONEY

_FLOATS = (T.DoubleType, T.FloatType)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN means missing: make it null in every float column."""
    changed = {
        f.name: F.when(~F.isnan(f.name), F.col(f.name))
        for f in df.schema.fields
        if isinstance(f.dataType, _FLOATS)
    }
    return df.withColumns(changed) if changed else df


def read_table(
    spark: SparkSession, path: str, money: list[str] | None = None
) -> DataFrame:
    """Parquet table with NaN as null; ``money`` columns become exact decimals."""
    df = nan_to_null(spark.read.parquet(path))
    casts = {name: F.col(name).cast(MONEY) for name in money or []}
    return df.withColumns(casts) if casts else df


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """Parquet table as stored, for filters that should reach the scan."""
    return spark.read.parquet(path)


def read_if_there(spark: SparkSession, path: str) -> DataFrame | None:
    """Parquet table, or None if nothing complete is stored there; other errors pass on."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def write_table(
    df: DataFrame,
    path: str,
    partition_by: list[str] | None = None,
    mode: str = "overwrite",
) -> None:
    """Parquet write, optionally partitioned (e.g. by month, for pruned slices).

    Rows of a partition value meet before the write, so that there are few files;
    the rebalance hint lets AQE split a value that holds too many rows. Files are
    compressed with zstd.
    """
    if not partition_by:
        df.write.mode(mode).option("compression", "zstd").parquet(path)
        return
    columns = [F.col(name) for name in partition_by]
    writer = df.hint("rebalance", *columns).write.mode(mode).option("compression", "zstd")
    writer.partitionBy(*partition_by).parquet(path)


def export_csv(df: DataFrame, path: str) -> None:
    """UTF-8 CSV with header, one file per partition."""
    df.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)
