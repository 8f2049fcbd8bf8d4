"""Join and size helpers that keep hot keys and growing sides in check."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: bytes up to which a counted result side may be broadcast
BROADCAST_BYTES = 8_000_000


def not_null(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows without a null in the columns.

    Plain null tests reach the Parquet scan, and equal the ones Spark derives for
    joins, so that a result used twice is shuffled once.
    """
    for name in columns:
        df = df.filter(F.col(name).isNotNull())
    return df


def attach(
    left: DataFrame, right: DataFrame, on: str | list[str], how: str = "left"
) -> DataFrame:
    """Join rows to a slim side with few rows per key, hot keys of ``left`` included.

    AQE can split a hot key of ``left`` only if both join inputs are plain
    shuffles. A side that was just aggregated or joined on the key already has the
    right partitioning, gets no shuffle of its own and so blocks the split. Joining
    on (hash of key, key) makes Spark shuffle that side once more, which is cheap as
    it is slim, and leaves both sides splittable. If it turns out small, AQE turns
    the join into a broadcast instead. A side of one row per order (line totals, line
    counts) is not slim; its second shuffle is the price of splitting hot keys.

    Keys of different types are cast to their common type first: hashes of an int and
    of the equal bigint differ. Types without a common one, such as text and numbers,
    are refused.
    """
    keys = [on] if isinstance(on, str) else list(on)
    left, right = with_common_keys(left, right, keys)
    digest = F.xxhash64(*keys)
    joined = left.withColumn("_key_hash", digest).join(
        right.withColumn("_key_hash", digest), ["_key_hash", *keys], how
    )
    columns = left.columns + [c for c in right.columns if c not in keys]
    return joined.select(*(left.columns if how in ("left_semi", "left_anti") else columns))


def with_common_keys(
    left: DataFrame, right: DataFrame, keys: list[str]
) -> tuple[DataFrame, DataFrame]:
    """Both sides with their keys in one type each; unchanged where types agree."""
    widest = None
    for key in keys:
        a, b = left.schema[key].dataType, right.schema[key].dataType
        if a == b:
            continue
        if isinstance(a, T.StringType) != isinstance(b, T.StringType):
            raise TypeError(f"key {key}: {a.simpleString()} and {b.simpleString()}")
        if widest is None:  # Spark's own rules for the union of both sides
            widest = left.select(*keys).union(right.select(*keys)).schema
        cast = F.col(key).cast(widest[key].dataType)
        left, right = left.withColumn(key, cast), right.withColumn(key, cast)
    return left, right


def local_folder(prefix: str) -> str:
    """Folder of a local session; it goes when the process ends."""
    folder = tempfile.mkdtemp(prefix=prefix)
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder; a temporary one only locally."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        context.setCheckpointDir(configured)
    elif context.master.startswith("local"):
        context.setCheckpointDir(local_folder("ledgerlens-checkpoint-"))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")


def pin(df: DataFrame) -> DataFrame:
    """Compute once and keep in the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


@contextmanager
def measured_broadcasts(spark: SparkSession, most: int = 1_000_000) -> Iterator[None]:
    """Jobs inside broadcast a join side only by its measured size, or where a plan asks for it.

    Spark takes a stored table for as large as its compressed files, so the driver collects
    sides of many times the session's limit, each a copy of its own. Inside, the limit holds
    for the rows that AQE has seen in a shuffle, and is ``most`` bytes at most, as several jobs
    run at a time; a limit set for AQE itself stays. Jobs that run later are not covered.
    """
    static, adaptive = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    before = {name: spark.conf.get(name, None) for name in (static, adaptive)}  # None: not set
    if before[adaptive] is None:
        limit = spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
        spark.conf.set(adaptive, str(min(limit, most)))
    spark.conf.set(static, "-1")
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def row_bytes(df: DataFrame) -> int:
    """Estimated bytes of a row: 16 per number, 64 per text or nested value."""
    wide = (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType)
    return sum(64 if isinstance(f.dataType, wide) else 16 for f in df.schema.fields)


def broadcast_if_small(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Pin, count, and mark for broadcast only if rows × estimated width fit.

    Beyond the limit the pinned side is returned as it is, and the caller's join
    becomes a shuffle join.
    """
    pinned = pin(df)
    small = pinned.count() * row_bytes(pinned) <= max_bytes
    return F.broadcast(pinned) if small else pinned
