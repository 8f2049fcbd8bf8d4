"""Reproducible shuffling into shards by a permutation of global row numbers."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import pin
from .common import column, mix

PART_BITS = 33


class Feistel:
    """Permutation of 0 … size-1, computable in both directions without a table.

    A number is cut into two halves; each round mixes one half into the other. The
    halves cover the next power of two; a result outside the range is permuted again
    until it falls inside (cycle walking), which keeps the mapping one-to-one.
    """

    def __init__(self, size: int, seed: int = 7, rounds: int = 6):
        if rounds % 2:
            raise ValueError("an odd number of rounds would swap halves of unequal width")
        self.size, self.rounds, self.seed = size, rounds, seed
        bits = max(2, (max(size, 1) - 1).bit_length())
        self.left, self.right = bits // 2, bits - bits // 2

    def widths(self) -> list[tuple[int, int]]:
        pair = (self.left, self.right)
        return [pair if r % 2 == 0 else pair[::-1] for r in range(self.rounds)]

    def once(self, x: np.ndarray) -> np.ndarray:
        for r, (left, right) in enumerate(self.widths()):
            low = x & np.uint64((1 << right) - 1)
            high = x >> np.uint64(right)
            high = high ^ (mix(low, self.seed * 64 + r) & np.uint64((1 << left) - 1))
            x = (low << np.uint64(left)) | high
        return x

    def back(self, x: np.ndarray) -> np.ndarray:
        for r, (left, right) in reversed(list(enumerate(self.widths()))):
            low = x >> np.uint64(left)
            high = x & np.uint64((1 << left) - 1)
            high = high ^ (mix(low, self.seed * 64 + r) & np.uint64((1 << left) - 1))
            x = (high << np.uint64(right)) | low
        return x

    def walk(self, x: np.ndarray, step) -> np.ndarray:
        x = step(np.asarray(x, dtype=np.uint64))
        outside = x >= np.uint64(self.size)
        while outside.any():
            x[outside] = step(x[outside])
            outside = x >= np.uint64(self.size)
        return x

    def position(self, row: np.ndarray) -> np.ndarray:
        """Place in the shuffled order of each row number."""
        return self.walk(row, self.once)

    def row(self, position: np.ndarray) -> np.ndarray:
        """Row number at each place in the shuffled order."""
        return self.walk(position, self.back)

    def row_at(self, shard: np.ndarray, slot: np.ndarray, shards: int) -> np.ndarray:
        """Row number in a slot of a shard: readers find a row without a table."""
        return self.row(np.asarray(slot, np.uint64) * np.uint64(shards) + np.asarray(shard, np.uint64))


def number_rows(df: DataFrame, order: list[str]) -> tuple[DataFrame, dict[int, int], int]:
    """Rows with ``_at`` (partition and place in it), offsets of the partitions, number.

    Rows are sorted by ``order`` over all partitions; rows that are equal in all of it
    are spread by a running number, so that a frequent value does not fill one
    partition. The sorted rows are pinned: both passes see the same partitions. One
    number per partition goes to the driver.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [column(c) for c in order]
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    placed = tied.repartitionByRange(parts, *keys, "_tie").sortWithinPartitions(*keys, "_tie")
    placed = pin(placed.drop("_tie").withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", PART_BITS)
    last = F.max(F.col("_at").bitwiseAND((1 << PART_BITS) - 1))
    counts = placed.groupBy(part.alias("part")).agg((last + 1).alias("n")).collect()
    offsets, total = {}, 0
    for r in sorted(counts):
        offsets[r["part"]] = total
        total += r["n"]
    return placed, offsets, total


def assign_shards(df: DataFrame, order: list[str], shards: int, seed: int = 7) -> DataFrame:
    """Columns of ``df`` plus row_number, position, shard and slot.

    Shards differ by one row at most, and slots of a shard count from 0 without gaps.
    The result depends on the rows, ``order``, ``shards`` and ``seed`` alone: nulls come
    first in the order; rows equal in all of ``order`` are interchangeable, so ``order``
    should name every column that is kept. Repeated rows each get a slot of their own;
    an empty table gives an empty table. Input columns with the names of results are
    replaced.
    """
    made = ["row_number", "position", "shard", "slot"]
    placed, offsets, total = number_rows(df.drop(*made), order)
    feistel, bits = Feistel(total, seed), PART_BITS

    @F.pandas_udf("row_number long, position long, shard int, slot long")
    def place(at: pd.Series) -> pd.DataFrame:
        at = at.to_numpy(np.int64)
        starts = pd.Series(at >> bits).map(offsets).to_numpy(np.int64)
        row = (starts + (at & ((1 << bits) - 1))).astype(np.uint64)
        position = feistel.position(row)
        shard, slot = position % np.uint64(shards), position // np.uint64(shards)
        return pd.DataFrame(
            {"row_number": row, "position": position, "shard": shard, "slot": slot}
        ).astype("int64")

    return placed.withColumn("_p", place("_at")).select(
        *(column(c) for c in placed.columns if c != "_at"), "_p.*"
    )
