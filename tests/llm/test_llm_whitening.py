import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import whitening
from ledgerlens.llm.queries import LLM_QUERIES


def brute(vectors):
    """Fit list, sums, eigenvalues and vectors by numpy."""
    x = np.array([[math.floor(256 * float(c)) for c in v] for v in vectors], dtype=object)
    fit = np.array(sorted(set(map(tuple, x))), dtype=object)
    n, total = len(fit), fit.sum(0)
    y = (fit.astype(float) * n - total.astype(float)) / n
    values, axes = np.linalg.eigh(y.T @ y / n)
    return x, n, total, values[::-1], axes[:, ::-1]


def good(v):
    return v is not None and all(c is not None and math.isfinite(c) for c in v)


def check(rows, vectors, key, top=4):
    """Rows of the query against numpy, signs aligned per component."""
    kept = {i: v for i, v in vectors.items() if good(v)}
    x, n, total, values, axes = brute(list(kept.values()))
    of = dict(zip(kept, x))
    assert len(rows) == len(kept) * top
    signs = {}
    for r in rows:
        k = r["component"] - 1
        row = of[r[key]]
        assert r["n"] == n
        assert r["deviation"] == sum((n * a - s) ** 2 for a, s in zip(row, total))
        want = float((row.astype(float) - total.astype(float) / n) @ axes[:, k]) / math.sqrt(values[k])
        sign = signs.setdefault(k, 1 if abs(want) < 1e-6 or want * r["whitened"] > 0 else -1)
        assert r["whitened"] == pytest.approx(sign * want, abs=1e-8)
        assert r["explained"] == pytest.approx(values[k] / values.sum(), rel=1e-10)
        assert r["identity_error"] < 1e-9


@pytest.mark.parametrize("size", ["sf0.001"])
def test_the_query_equals_numpy_on_the_whole_table(spark, size):
    folder = f"/root/testdata/{size}"
    vectors = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()}
    rows = LLM_QUERIES["op11_embedding_whitening"](spark, folder).collect()
    check(rows, vectors, "vec_id")
    assert len({r["identity_error"] for r in rows}) == 1


def test_nulls_ties_repeats_and_extra_columns(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(i, [float(c) for c in rng.normal(0, 1, 6) * [9, 5, 3, 2, 1, 0.2]]) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(200)]
    rows += [(2000, None), (2001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2002, [math.nan] * 6), (2003, [math.inf] * 6)]
    rows += [(7, rows[7][1]), (2004, [-0.0] * 6), (2005, [-1e-9] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    df = df.withColumn("n", F.lit("clash")).withColumn("whitened", F.lit(1)).withColumn("dim", F.lit(None).cast("int"))
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    found = LLM_QUERIES["op11_embedding_whitening"](spark, str(tmp_path)).collect()
    vectors = dict(rows)
    ids = [r["vec_id"] for r in found]
    assert ids.count(7) == 8 and ids.count(1100) == 4 and not {2000, 2001, 2002, 2003} & set(ids)
    once = [r for k, r in enumerate(found) if r["vec_id"] != 7 or ids[:k].count(7) < 4]
    check(once, vectors, "vec_id")


def test_large_offsets_lose_no_digits(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(2**40 + a), float(-(2**41) + b)]) for i, (a, b) in enumerate(rng.integers(0, 50, (400, 2)))]
    df = spark.createDataFrame(rows, "i long, v array<double>")
    space = whitening.fit(df, "v", scale=1)[2]
    x = np.array(sorted({(int(v[0]) - 2**40, int(v[1]) + 2**41) for _, v in rows}), float)
    want = np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1]
    assert space.values == pytest.approx(want, rel=1e-12) and space.identity_error < 1e-12
    # whole numbers beyond a long, sums beyond one, deviations that do not fit: no crash
    huge = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [9e18, 5.0])], "i long, v array<double>")
    spaces = whitening.fit(huge, "v")
    found = {r["i"]: r for r in whitening.whiten(huge, spaces, {"i": "i"}, "v").collect()}
    assert len(found) == 3 and all(r["deviation"] is None for r in found.values())


def test_rank_and_lengths(spark):
    rows = [(i, [float(i), 2.0 * i, 7.0]) for i in range(20)] + [(100 + i, [float(i % 5)]) for i in range(20)]
    rows += [(200, []), (201, [1.0, 2.0]), (202, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "i long, v array<float>")
    spaces = whitening.fit(df, "v")
    assert {d: len(s.values) for d, s in spaces.items()} == {3: 1, 1: 1, 2: 0}
    found = {r["i"]: r for r in whitening.whiten(df, spaces, {"i": "i"}, "v").collect()}
    assert found[0]["explained"] == pytest.approx([1.0]) and found[201]["whitened"] == [] and 200 not in found
    assert found[100]["n"] == 5 and found[5]["n"] == 20


def test_empty_table(spark):
    empty = spark.createDataFrame([], "i long, v array<float>")
    assert whitening.fit(empty, "v") == {}
    assert whitening.whiten(empty, {}, {"i": "i"}, "v").count() == 0


@pytest.mark.parametrize("size,rank", [(1, 1), (7, 7), (40, 40), (33, 5)])
def test_cholesky_and_jacobi_equal_eigh(size, rank):
    rng = np.random.default_rng(size)
    half = rng.normal(size=(size, rank)) * 10.0 ** rng.uniform(-1, 1, (size, 1))
    a = half @ half.T
    factor = whitening.pivoted_cholesky(a)
    assert factor.shape[1] == rank and np.allclose(factor @ factor.T, a, atol=1e-9 * a.max())
    values, axes = whitening.one_sided_jacobi(factor)
    want = np.linalg.eigvalsh(a)[::-1][:rank]
    assert np.allclose(values, want, atol=1e-10 * want[0])
    assert np.allclose(axes.T @ axes, np.eye(rank), atol=1e-9)
    assert np.allclose(a @ axes, axes * values, atol=1e-9 * want[0])
