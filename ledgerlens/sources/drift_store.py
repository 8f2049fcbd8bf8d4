"""Stored drift reports, computed only if absent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.drift import Day, ordered
from .tables import read_if_there, read_raw, write_table

KEYS = ["source", "reference_start", "reference_end", "current_start", "current_end"]


class DriftStore:
    """Reports keyed by source and the two date ranges."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def _path(self, key: list[str]) -> str:
        parts = [f"{name}={value}" for name, value in zip(KEYS, key)]
        return "/".join([self.root, *parts])

    def report(
        self,
        source: str,
        reference: tuple[Day, Day],
        current: tuple[Day, Day],
        compute: Callable[[], DataFrame],
        refresh: bool = False,
    ) -> DataFrame:
        """The stored report, or a new one if there is none or on ``refresh``."""
        path = self._path([source, *ordered(*reference), *ordered(*current)])
        stored = None if refresh else read_if_there(self.spark, path)
        if stored is not None:
            return stored
        write_table(compute().coalesce(1), path)
        return read_raw(self.spark, path)

    def catalogue(self) -> DataFrame:
        """Source and date ranges of all stored reports."""
        stored = read_if_there(self.spark, self.root)
        if stored is None:
            schema = ", ".join(f"{k} string" for k in KEYS)
            return self.spark.createDataFrame([], schema)
        return stored.select(*[F.col(k).cast("string") for k in KEYS]).distinct()
