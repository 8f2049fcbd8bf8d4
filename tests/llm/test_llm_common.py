import random

import pytest

from ledgerlens.llm import common


@pytest.mark.parametrize("edges_at_once", [300_000, 3])
def test_components_equal_brute_force(spark, monkeypatch, edges_at_once):
    monkeypatch.setattr(common, "FOREST_EDGES", edges_at_once)
    draw = random.Random(2)
    edges = [(draw.randrange(300), draw.randrange(300)) for _ in range(160)]
    edges += [(k, k + 1) for k in range(1000, 1120)] + [(2000, k) for k in range(2001, 2200)] + [(5, 5)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    df = spark.createDataFrame(edges, "a long, b long").repartition(6)
    found = {r["node"]: r["component"] for r in common.components(df).collect()}
    single = {x for a, b in edges for x in (a, b)} - {x for a, b in edges if a != b for x in (a, b)}
    assert found == {x: find(x) for x in parent if x not in single}
    assert common.components(df.limit(0)).count() == 0


def test_a_run_of_texts_is_bounded_and_complete(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(common, "SLICE_CHARS", 10)
    texts = ["abc", None, "", "x" * 50, "de", "f" * 9]
    runs = list(common.slices(pa.array(texts)))
    assert [t for _, run in runs for t in run] == texts
    assert [start for start, _ in runs] == [sum(len(r) for _, r in runs[:k]) for k in range(len(runs))]


def test_freed_arrow_memory_goes_back_after_every_result(monkeypatch):
    """A worker goes on to other tasks; what it has freed must not stay with it."""
    import pyarrow as pa

    log = []

    class Pool:
        def release_unused(self):
            log.append("memory")

    monkeypatch.setattr(pa, "default_memory_pool", Pool)
    made = common.frugal(lambda batches: (b + 1 for b in batches), lambda: log.append("model"))
    assert list(made(iter([1, 2]))) == [2, 3]
    assert log == ["memory", "memory", "model", "memory"]
    log.clear()
    stopped = made(iter([1, 2]))  # Spark may stop a task early
    next(stopped)
    stopped.close()
    assert log == ["model", "memory"]
