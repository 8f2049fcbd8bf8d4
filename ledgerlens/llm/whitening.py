"""Whitening of embeddings: exact integer sums, pivoted Cholesky, one-sided Jacobi.

Every entry c of a vector becomes the whole number floor(scale · c). The distinct vectors
are the fit list. Its centred scatter is factored (pivoted Cholesky), and one-sided Jacobi
rotates the columns of the triangular factor until they are orthogonal: their squared
norms are the eigenvalues of the scatter, the normalised columns its eigenvectors. The
scatter itself is never squared or rotated, so small eigenvalues keep their digits.

Spark computes the fit list (one shuffle, equal vectors combined before it), the sums and
the scatter; only the scatter, components × components, is solved on the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import pin
from .common import column

#: whole numbers up to here are centred exactly before they become doubles
EXACT = 1 << 61
LONG = 1 << 63
#: sweeps of Jacobi; some ten are enough for a thousand columns
SWEEPS = 60


@dataclass(frozen=True)
class Space:
    """What was learned from the vectors of one length.

    ``total`` holds the exact sum per dimension, ``values`` the falling eigenvalues of
    the covariance, ``axes`` the eigenvectors as columns.
    """

    n: int
    total: list[int]
    values: np.ndarray
    axes: np.ndarray
    explained: np.ndarray
    identity_error: float

    @property
    def centre(self) -> tuple[np.ndarray, np.ndarray]:
        return centre(self.n, self.total)

    @property
    def scaled(self) -> np.ndarray:
        return self.axes / np.sqrt(self.values)


def centre(n: int, total: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Mean as a whole number and a rest of at most a half, so that no digits get lost."""
    whole = [(2 * s + n) // (2 * n) for s in total]
    rest = [(s - n * w) / n for s, w in zip(total, whole)]
    return np.array(whole, np.int64), np.array(rest, np.float64)


def usable(vector: Column) -> Column:
    """Not null, and no entry null, NaN or infinite."""
    finite = F.forall(vector, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False))


def whole_numbers(entries: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale · c) as long; values beyond a long become the largest or smallest."""
    with np.errstate(over="ignore"):
        scaled = np.floor(entries.astype(np.float64) * scale)
    inside = np.abs(scaled) < float(LONG)
    x = np.where(inside, scaled, 0.0).astype(np.int64)
    return np.where(inside, x, np.where(scaled > 0, LONG - 1, -LONG)).astype(np.int64)


def by_length(vectors: pa.Array, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in the batch, whole numbers as a matrix) for each length of a batch."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    entries = whole_numbers(vectors.flatten().to_numpy(zero_copy_only=False), scale)
    ends = np.cumsum(sizes := vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
    for size in np.unique(sizes):
        places = np.flatnonzero(sizes == size)
        yield places, entries[(ends[places] - size)[:, None] + np.arange(size)]


def pack(scale: int) -> Callable:
    """Vectors → (dim, x): x in the narrowest whole-number type that holds the vector.

    Equal vectors give equal bytes, so Spark can compare and shuffle short binaries; the
    type follows from the number of bytes and the length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, x in by_length(batch.column("v"), scale):
                if not x.shape[1]:
                    continue
                low, high = x.min(1), x.max(1)
                done = np.zeros(len(x), bool)
                for width in (1, 2, 4, 8):
                    limits = np.iinfo(f"i{width}")
                    rows = ~done & (low >= limits.min) & (high <= limits.max)
                    done |= rows
                    if rows.any():
                        raw = x[rows].astype(f"<i{width}")
                        cells = pa.FixedSizeBinaryArray.from_buffers(
                            pa.binary(width * x.shape[1]), len(raw), [None, pa.py_buffer(raw.tobytes())]
                        )
                        dims = pa.array(np.full(len(raw), x.shape[1]), pa.int32())
                        yield pa.RecordBatch.from_arrays([dims, cells.cast(pa.binary())], names=["dim", "x"])

    return run


def unpack(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """Matrices of whole numbers, one per length and width of a batch."""
    dims = batch.column("dim").to_numpy()
    cells = batch.column("x")
    sizes = pc.binary_length(cells).to_numpy()
    for dim, size in {(int(d), int(s)) for d, s in zip(dims, sizes)}:
        some = cells.filter(pa.array((dims == dim) & (sizes == size)))
        raw = b"".join(some.to_pylist())
        yield dim, np.frombuffer(raw, f"<i{size // dim}").reshape(-1, dim).astype(np.int64)


def exact_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per length and place: number of vectors and their sum, as whole numbers of any size."""
    numbers: dict[int, int] = {}
    totals: dict[int, list[int]] = {}
    for batch in batches:
        for dim, x in unpack(batch):
            high, low = (x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)
            part = [(int(h) << 32) + int(k) for h, k in zip(high, low)]
            numbers[dim] = numbers.get(dim, 0) + len(x)
            totals[dim] = [a + b for a, b in zip(totals.get(dim, [0] * dim), part)]
    for dim, total in totals.items():
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([dim] * dim, pa.int32()),
                pa.array(range(dim), pa.int32()),
                pa.array([numbers[dim]] * dim, pa.int64()),
                pa.array([Decimal(t) for t in total], pa.decimal128(38, 0)),
            ],
            names=["dim", "place", "n", "total"],
        )


def centred(x: np.ndarray, whole: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """x minus the mean, subtracted in whole numbers first."""
    if len(x) and max(int(x.max()), -int(x.min()), *(abs(int(w)) for w in whole)) >= EXACT:
        return x.astype(np.float64) - whole.astype(np.float64) - rest
    return (x - whole).astype(np.float64) - rest


def scatter(fit_list: DataFrame, centres: dict, project: dict) -> dict[int, np.ndarray]:
    """Per length: sum over the fit list of the outer products of centred vectors.

    ``project`` maps a length to a matrix that centred vectors are multiplied with first.
    Each task adds up its vectors and sends one triangle; Spark adds up the triangles.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, x in unpack(batch):
                y = centred(x, *centres[dim])
                if dim in project:
                    y = y @ project[dim]
                sums[dim] = sums.get(dim, 0) + y.T @ y
        for dim, found in sums.items():
            size = len(found)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([dim] * size, pa.int32()),
                    pa.array(range(size), pa.int32()),
                    pa.array([found[k, : k + 1] for k in range(size)], pa.list_(pa.float64())),
                ],
                names=["dim", "row", "cells"],
            )

    parts = fit_list.mapInArrow(run, "dim int, row int, cells array<double>")
    cells = parts.select("dim", "row", F.posexplode("cells").alias("col", "value"))
    out: dict[int, np.ndarray] = {}
    for r in cells.groupBy("dim", "row", "col").agg(F.sum("value").alias("value")).collect():
        size = project[r["dim"]].shape[1] if r["dim"] in project else r["dim"]
        found = out.setdefault(r["dim"], np.zeros((size, size)))
        found[r["row"], r["col"]] = found[r["col"], r["row"]] = r["value"]
    return out


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """Factor f with f @ f.T == a, as many columns as ``a`` has rank.

    The largest remaining diagonal entry is the next pivot; in the order of the pivots
    the factor is lower triangular. It ends where only rounding is left.
    """
    size = len(a)
    factor, left, order = np.zeros((size, size)), a.diagonal().copy(), np.arange(size)
    least = size * np.finfo(float).eps * max(left.max(initial=0.0), 0.0)
    for k in range(size):
        best = k + int(np.argmax(left[order[k:]]))
        if left[order[best]] <= least:
            return factor[:, :k]
        order[[k, best]] = order[[best, k]]
        pivot, rest = order[k], order[k + 1 :]
        factor[pivot, k] = np.sqrt(left[pivot])
        factor[rest, k] = (a[rest, pivot] - factor[rest, :k] @ factor[pivot, :k]) / factor[pivot, k]
        left[rest] -= factor[rest, k] ** 2
    return factor


def rounds(players: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of columns in rounds of disjoint pairs; after all rounds each pair has met."""
    seats = list(range(players + players % 2))
    half = len(seats) // 2
    for _ in range(len(seats) - 1):
        pairs = [(a, b) for a, b in zip(seats[:half], seats[: half - 1 : -1]) if max(a, b) < players]
        yield np.array([p[0] for p in pairs], int), np.array([p[1] for p in pairs], int)
        seats = [seats[0], seats[-1], *seats[1:-1]]


def one_sided_jacobi(factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(squared norms, unit columns) of ``factor`` with its columns rotated to orthogonality.

    All pairs of a round are disjoint and are rotated together. Sweeps end when no pair
    is further from a right angle than rounding allows.
    """
    w = factor.copy()
    limit = max(1, len(w)) * np.finfo(float).eps
    for _ in range(SWEEPS):
        worst = 0.0
        for i, j in rounds(w.shape[1]):
            a, b = w[:, i], w[:, j]
            aa, bb, ab = (a * a).sum(0), (b * b).sum(0), (a * b).sum(0)
            slant = np.abs(ab) / np.sqrt(aa * bb)
            worst = max(worst, slant.max(initial=0.0))
            turn = slant > limit
            zeta = (bb - aa) / (2 * np.where(turn, ab, 1.0))
            t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            t = np.where(turn, t, 0.0)
            cos = 1 / np.hypot(1.0, t)
            sin = cos * t
            w[:, i], w[:, j] = a * cos - b * sin, a * sin + b * cos
        if worst <= limit:
            break
    norms = (w * w).sum(0)
    order = np.argsort(-norms, kind="stable")
    return norms[order], (w / np.sqrt(norms))[:, order]


def fit(
    df: DataFrame, vector: str = "embedding", components: int | None = None, scale: int = 256
) -> dict[int, Space]:
    """Learn a space per vector length from the distinct whole-number vectors.

    Vectors that are null or hold null, NaN or infinite entries take no part, nor do
    empty ones. Vectors of different lengths lie in different spaces, each learned from
    its own vectors. A vector that occurs often counts once. Components without variance
    (fewer distinct vectors than dimensions, constant entries) do not exist: a space has
    at most as many as the rank of its scatter, possibly none, and ``components`` at
    most. Equal eigenvalues may come in any order. An empty table gives no space.

    ``identity_error`` is measured on the fit list: the largest absolute entry of the
    covariance of the whitened vectors minus the identity.
    """
    vectors = df.select(column(vector).alias("v")).where(usable(F.col("v")))
    fit_list = pin(vectors.mapInArrow(pack(scale), "dim int, x binary").distinct())
    sums = fit_list.mapInArrow(exact_sums, "dim int, place int, n long, total decimal(38,0)")
    sums = sums.groupBy("dim", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    numbers, totals = {}, {}
    for r in sums.collect():
        numbers[r["dim"]] = r["n"]
        totals.setdefault(r["dim"], [0] * r["dim"])[r["place"]] = int(r["total"])
    centres = {dim: centre(numbers[dim], totals[dim]) for dim in totals}
    solved = {}
    for dim, found in scatter(fit_list, centres, {}).items():
        norms, axes = one_sided_jacobi(pivoted_cholesky(found))
        values = norms / numbers[dim]
        share = norms / max(found.trace(), np.finfo(float).tiny)
        solved[dim] = tuple(x[..., :components] for x in (values, axes, share))
    project = {dim: axes / np.sqrt(values) for dim, (values, axes, _) in solved.items() if len(values)}
    whitened = scatter(fit_list.where(F.col("dim").isin(list(project))), centres, project) if project else {}
    spaces = {}
    for dim, (values, axes, share) in solved.items():
        error = 0.0
        if dim in whitened:
            error = float(np.abs(whitened[dim] / numbers[dim] - np.eye(len(values))).max())
        spaces[dim] = Space(numbers[dim], totals[dim], values, axes, share, error)
    return spaces


def deviations(x: np.ndarray, n: int, total: list[int]) -> list[int | None]:
    """Sum of (n·x - total)² per row, exact; None beyond a long.

    Arithmetic of longs wraps, so a result that fits is right whatever happened between;
    a double tells which rows fit, and near the border whole numbers decide.
    """
    rough = ((n * x.astype(np.float64) - np.array(total, np.float64)) ** 2).sum(1)
    with np.errstate(over="ignore"):
        wrapped = np.array([t & (2 * LONG - 1) for t in total], np.uint64)
        gap = x.astype(np.uint64) * np.uint64(n) - wrapped
        sure = (gap * gap).sum(1, dtype=np.uint64)
    out = []
    for k, value in enumerate(sure.tolist()):
        if rough[k] > LONG / 4:
            value = sum((n * int(a) - t) ** 2 for a, t in zip(x[k], total))
        out.append(value if value < LONG else None)
    return out


def whiten(
    df: DataFrame, spaces: dict[int, Space], keep: dict[str, str], vector: str = "embedding", scale: int = 256
) -> DataFrame:
    """Kept columns, n, deviation, whitened and explained (arrays), identity_error.

    ``keep`` maps output names to input columns. One row per usable vector of a known
    length, repeated rows included; others have no row. ``whitened`` is the centred
    vector along each component over the square root of its eigenvalue; ``deviation``
    the exact sum of (n·x - total)², null where it exceeds a long. ``scale`` must be that
    of ``fit``. Kept columns may have any name but those of the results.
    """
    frame = df.select(*(column(c).alias(n) for n, c in keep.items()), column(vector).alias("_vector"))
    made = "n long, deviation long, whitened array<double>, explained array<double>, identity_error double"
    out = frame.drop("_vector").schema
    for field in frame.sparkSession.createDataFrame([], made).schema.fields:
        out = out.add(field)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for places, x in by_length(batch.column("_vector"), scale):
                space = spaces.get(x.shape[1])
                if space is None:
                    continue
                rows, count = batch.take(pa.array(places)), len(places)
                white = centred(x, *space.centre) @ space.scaled
                arrays = [rows.column(n).cast(arrow.field(n).type) for n in keep]
                new = [
                    [space.n] * count,
                    deviations(x, space.n, space.total),
                    list(white),
                    [space.explained] * count,
                    [space.identity_error] * count,
                ]
                arrays += [pa.array(v, arrow.field(len(keep) + k).type) for k, v in enumerate(new)]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return frame.where(usable(F.col("_vector"))).mapInArrow(run, out)
