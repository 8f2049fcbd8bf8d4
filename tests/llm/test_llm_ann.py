import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ledgerlens.llm import ann
from ledgerlens.operators.joins import pin


def brute(rows, keep=5):
    usable = {(i, tuple(v)) for i, v in rows if i is not None and v and None not in v
              and np.isfinite(v).all() and any(v)}
    out = {}
    for i in {i for i, _ in usable if i % 50 == 0}:
        scores = {}
        for own in (np.array(v) for j, v in usable if j == i):
            for j, v in usable:
                if j != i and len(v) == len(own):
                    v = np.array(v)
                    score = own @ v / (np.sqrt(own @ own) * np.sqrt(v @ v))
                    scores[j] = max(scores.get(j, -2), score)
        out[i] = sorted(((-round(s, 12), j) for j, s in scores.items()))[:keep]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, rank int")


def test_small_tables_equal_brute_force(spark):
    random = np.random.default_rng(1)
    rows = [(i, random.normal(size=8).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(150)]  # equal vectors, queries among them
    rows += [(50, rows[50][1])] * 2 + [(500, [2 * x for x in rows[3][1]])]
    rows += [(2000, None), (2050, [0.0] * 8), (2100, [1.0] * 7 + [float("nan")]), (2150, [None] + [1.0] * 7),
             (2200, [float("inf")] * 8), (2250, []), (2300, [1.0, 2.0]), (None, rows[0][1])]
    rows += [(3000 + 10 * i, random.normal(size=3).tolist()) for i in range(40)]  # a rarer length
    df = frame(spark, rows)
    found = ann.nearest(df, df.where("vec_id % 50 = 0")).collect()
    want = {query: own for query, own in brute(rows).items() if own}
    assert len(want[3000]) == 5 and 2300 not in want
    got = {}
    for r in found:
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(want)
    for query, own in got.items():
        own.sort()
        assert [k for k, _, _ in own] == list(range(1, len(want[query]) + 1))
        assert [v for _, v, _ in own] == [v for _, v in want[query]]
        assert all(abs(s + w[0]) < 1e-9 for (_, _, s), w in zip(own, want[query]))


def test_few_or_no_vectors(spark):
    df = frame(spark, [(0, [1.0, 0.0]), (1, [1.0, 1.0])])
    assert [tuple(r)[:3] for r in ann.nearest(df, df.where("vec_id = 0")).collect()] == [(0, 1, 1)]
    none = frame(spark, [(0, None)])
    assert ann.nearest(none, none).count() == 0 and ann.nearest(none.limit(0), none.limit(0)).count() == 0


def test_recall_with_many_lists(spark, monkeypatch):
    monkeypatch.setattr(ann, "LIST", 40)
    random = np.random.default_rng(2)
    centres = random.normal(size=(60, 16))
    rows = [(i, (centres[i % 60] + 0.4 * random.normal(size=16)).tolist()) for i in range(3000)]
    df = frame(spark, rows)
    found = {(r["query_id"], r["vec_id"]) for r in ann.nearest(df, df.where("vec_id % 50 = 0")).collect()}
    matrix = np.array([v for _, v in rows])
    matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
    scores = matrix[::50] @ matrix.T
    scores[np.arange(60), np.arange(0, 3000, 50)] = -2
    want = {(50 * q, int(v)) for q in range(60) for v in np.argsort(-scores[q])[:5]}
    assert len(found & want) >= 0.9 * len(want)


def test_balanced_lists_and_graph_search():
    random = np.random.default_rng(3)
    points = ann.unit(random.normal(size=(2000, 12)))
    index = ann.Index.fit(points, 100)
    ids, apart = index.search(points[:200], 5)
    exact = np.argsort(-(points[:200] @ index.centroids.T), axis=1)[:, :5]
    same = np.mean([len(set(a) & set(b)) / 5 for a, b in zip(ids, exact)])
    assert same > 0.95 and (np.diff(apart, axis=1) >= -1e-12).all()
    own = np.bincount(np.argmax(points @ index.centroids.T, axis=1), minlength=len(index.centroids))
    assert own.max() <= 6 * own.mean()


def test_recall_without_clusters_and_with_hundreds_of_lists(spark, monkeypatch):
    monkeypatch.setattr(ann, "LIST", 160)
    fitted, fit = [], ann.Index.fit
    monkeypatch.setattr(ann.Index, "fit", staticmethod(lambda *a: fitted.append(fit(*a)) or fitted[-1]))
    df = spark.range(0, 40_000, 1, 8).select(
        F.col("id").alias("vec_id"), F.array(*(F.randn(k) for k in range(64))).alias("embedding")
    )
    df = pin(df)
    found = {(r["query_id"], r["vec_id"]) for r in ann.nearest(df, df.where("vec_id % 50 = 0")).collect()}
    unit = ann.unit(ann.matrix(df.orderBy("vec_id").toArrow()["embedding"].combine_chunks()))
    scores = unit[::50] @ unit.T
    scores[np.arange(800), np.arange(0, 40_000, 50)] = -2
    want = {(50 * q, int(v)) for q in range(800) for v in np.argpartition(-scores[q], 5)[:5]}
    assert len(fitted[0].centroids) >= 200 and len(found & want) >= 0.97 * len(want)


def test_a_query_reads_the_nearest_lists_at_any_distance():
    index = ann.Index.fit(ann.unit(np.random.default_rng(5).normal(size=(400, 6))), 40)
    batch = pa.RecordBatch.from_pylist([{"vid": 7, "v": index.centroids[3].tolist()}])
    (rows,) = ann.post({6: (100, index)}, None, ann.PROBE_RATIO, 5)([batch])
    assert rows.num_rows == 5 and 103 in rows.column("list").to_pylist()


def test_lists_grow_with_the_table_within_the_bytes_of_the_index():
    assert ann.lists_by_length({64: 200_000}) == {64: 391}
    assert ann.lists_by_length({64: 2_000_000}) == {64: 3907}
    many = ann.lists_by_length({64: 10**10, 1536: 10**8, 3: 500})
    assert set(many) == {64} or sum(8 * d * n for d, n in many.items()) <= ann.INDEX_BYTES
    assert ann.lists_by_length({}) == {} and ann.lists_by_length({8: 512}) == {}


def test_the_walk_finds_the_lists_within_the_ratio():
    random = np.random.default_rng(6)
    for points in (random.normal(size=(6000, 24)), np.repeat(random.normal(size=(60, 24)), 100, axis=0) + 0.2 * random.normal(size=(6000, 24))):
        index = ann.Index.fit(ann.unit(points), 150)
        queries = ann.unit(points[::40])
        q, k = index.within(queries, ann.PROBE_RATIO, ann.LEAST_PROBES)
        apart = np.sqrt(np.maximum(2 - 2 * queries @ index.centroids.T, 0))
        want = apart <= ann.PROBE_RATIO * apart.min(axis=1, keepdims=True)
        found = np.zeros_like(want)
        found[q, k] = True
        assert (found & want).sum() >= 0.98 * want.sum()
        assert found.sum(axis=1).min() >= ann.LEAST_PROBES


def test_parallel_vectors_that_tie_keep_the_smallest_ids():
    v = np.array([0.3, -1.7, 0.9, 2.1])
    rows = [{"vid": i, "v": (v * 2.0 ** (i % 9 - 4)).tolist()} for i in range(200)]
    vectors = pa.Table.from_pylist(rows[::-1])
    found = ann.nearest_in_block(6)(vectors.slice(0, 40), vectors)
    assert found["vid"].to_pylist() == list(range(6)) * 40
    # multiples whose scores differ by rounding alone: the order is that of the scores
    v = np.random.default_rng(0).normal(size=64)
    given = [v * (i + 1) for i in range(200)]
    table = pa.Table.from_pylist([{"vid": i, "v": w.tolist()} for i, w in enumerate(given)])
    q = given[5]
    exact = sorted((-(q * w).sum() / (np.sqrt((q * q).sum()) * np.sqrt((w * w).sum())), i) for i, w in enumerate(given))
    found = ann.nearest_in_block(6)(table.slice(5, 1), table)
    assert found["vid"].to_pylist() == [i for _, i in exact[:6]]
