import numpy as np
import pytest

from ledgerlens.llm import sharding


@pytest.mark.parametrize("size", [1, 2, 3, 8, 100, 1025, 4096])
def test_the_permutation_is_one_to_one_and_invertible(size):
    feistel = sharding.Feistel(size)
    rows = np.arange(size, dtype=np.uint64)
    positions = feistel.position(rows)
    assert sorted(positions) == list(range(size))
    assert (feistel.row(positions) == rows).all()
    shard, slot = positions % np.uint64(8), positions // np.uint64(8)
    assert (feistel.row_at(shard, slot, 8) == rows).all()


def placed(df):
    return sorted(map(tuple, sharding.assign_shards(df, df.columns[:2], 8).collect()), key=repr)


def test_shards_are_even_gapless_and_reproducible(spark):
    rows = [(i % 40, "t" * (i % 3), "x") for i in range(203)] + [(None, None, None)] * 60
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string").repartition(5)
    found = sharding.assign_shards(df, ["doc_id", "text"], 8).collect()
    shards = {}
    for r in found:
        shards.setdefault(r["shard"], []).append(r["slot"])
    sizes = [len(v) for v in shards.values()]
    assert len(found) == 263 and max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in shards.values())
    keys = ["doc_id", "text", "position"]
    again = sharding.assign_shards(df.repartition(3), ["doc_id", "text"], 8)
    assert sorted(map(repr, again.select(keys).collect())) == sorted(
        repr(r) for r in sharding.assign_shards(df, ["doc_id", "text"], 8).select(keys).collect())


def test_empty_table(spark):
    assert sharding.assign_shards(spark.createDataFrame([], "doc_id long"), ["doc_id"], 8).count() == 0
