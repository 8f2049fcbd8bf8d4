"""Approximate nearest neighbours by cosine: balanced posting lists.

Centroids are fitted on a bounded sample by balanced splitting. Every vector is posted
to its nearest lists (boundary vectors to several), a query reads the lists whose
centroid is not much further away than the nearest one, however many these are: few
where vectors form clusters, most where they do not. Both find their lists on a
neighbour graph of the centroids in memory. The number of lists grows with the table.
Lists are cut into blocks, so that neither a full list nor a list that many queries read
is one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.joins import pin
from .common import column, skewed_join

#: vectors, about, that the centroids are fitted on, and for each list beyond; the only
#: thing that is sampled
SAMPLE, PER_LIST = 20_000, 40
#: vectors per list aimed at
LIST = 512
#: bytes of all centroids, which every task holds: with 64 components some 8,000 lists.
#: The sample is at most PER_LIST times that. Beyond, lists get longer, in more blocks
INDEX_BYTES = 4_000_000
#: most lists a vector is posted to, and how much further off than the nearest they may be
COPIES, COPY_RATIO = 2, 1.03
#: how much further off than the nearest the lists are that a query reads, and the nearest
#: ones that it reads at any distance; there is no upper limit to their number
PROBE_RATIO, LEAST_PROBES = 1.3, 8
#: bytes of the vectors in a block
BLOCK_BYTES = 1 << 23
#: pairs of queries and centroids looked at together
WALK = 1 << 22
#: more than rounding can move a cosine of unit vectors
MARGIN = 1e-9
DEGREE, BEAM = 16, 64


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


@dataclass
class Index:
    """Centroids with the graph of their nearest neighbours."""

    centroids: np.ndarray
    graph: np.ndarray
    entries: np.ndarray

    @staticmethod
    def fit(sample: np.ndarray, lists: int, seed: int = 11) -> Index:
        random = np.random.default_rng(seed)
        leaf = max(1, math.ceil(len(sample) / lists))
        work, means = [sample], []
        while work:
            own = work.pop()
            if len(own) <= leaf or (own == own[0]).all():
                means.append(own.mean(axis=0))
                continue
            parts = Index.balanced(own, min(8, math.ceil(len(own) / leaf)), random)
            filled = [own[parts == k] for k in range(parts.max() + 1)]
            filled = [p for p in filled if len(p)]
            if len(filled) == 1:  # equal as far as the split can tell
                filled = np.array_split(own, 2)
            work += filled
        means = np.array(means)
        means[~means.any(axis=1)] = sample[0]
        return Index.link(unit(means), random)

    @staticmethod
    def balanced(points: np.ndarray, parts: int, random) -> np.ndarray:
        """Spherical k-means in which crowded centres get a handicap."""
        centres = points[random.choice(len(points), parts, replace=False)]
        handicap = np.zeros(parts)
        for _ in range(12):
            own = np.argmax(points @ centres.T - handicap, axis=1)
            counts = np.bincount(own, minlength=parts)
            handicap += 0.05 * (counts * parts / len(points) - 1)
            for k in np.flatnonzero(counts):
                mean = points[own == k].mean(axis=0)
                centres[k] = mean / max(np.sqrt(mean @ mean), 1e-12)
        return own

    @staticmethod
    def link(centroids: np.ndarray, random) -> Index:
        number = len(centroids)
        degree = min(DEGREE, number)
        near = np.empty((number, degree), np.int64)
        for start in range(0, number, 512):
            close = -(centroids[start : start + 512] @ centroids.T)
            few = np.argpartition(close, degree - 1, axis=1)[:, :degree]
            order = np.argsort(np.take_along_axis(close, few, axis=1), axis=1)
            near[start : start + 512] = np.take_along_axis(few, order, axis=1)
        far = random.integers(0, number, (number, 4))  # long ways keep the graph connected
        entries = random.choice(number, min(number, 8), replace=False)
        return Index(centroids, np.hstack([near, far]), entries)

    def search(self, queries: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
        """Nearest centroids and distances: best-first walks, all queries in step."""
        beam = max(BEAM, keep)
        rows = np.arange(len(queries))[:, None]
        ids = np.tile(self.entries, (len(queries), 1))
        seen = np.zeros((len(queries), len(self.centroids)), bool)
        seen[rows, ids] = True
        apart = 1 - np.einsum("qd,qkd->qk", queries, self.centroids[ids])
        done = np.zeros(ids.shape, bool)
        while True:
            waiting = np.where(done | ~np.isfinite(apart), np.inf, apart)
            best = waiting.argmin(axis=1)
            if not np.isfinite(waiting[rows[:, 0], best]).any():
                break
            done[rows[:, 0], best] = True
            new = np.sort(self.graph[ids[rows[:, 0], best]], axis=1)
            going = np.isfinite(waiting[rows[:, 0], best])[:, None]
            fresh = ~seen[rows, new] & going
            fresh[:, 1:] &= new[:, 1:] != new[:, :-1]
            seen[rows, new] |= going  # the same for all places of an id
            more = 1 - np.einsum("qd,qkd->qk", queries, self.centroids[new])
            apart = np.hstack([apart, np.where(fresh, more, np.inf)])
            ids, done = np.hstack([ids, new]), np.hstack([done, np.zeros(new.shape, bool)])
            order = np.argsort(apart, axis=1, kind="stable")[:, :beam]
            ids, apart, done = ids[rows, order], apart[rows, order], done[rows, order]
        distance = np.sqrt(np.maximum(2 * apart[:, :keep], 0))
        return ids[:, :keep], distance

    def within(self, queries: np.ndarray, ratio: float, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, list) pairs: lists at most ``ratio`` times as far as the nearest, and the ``least`` nearest.

        A walk finds the nearest lists; from those near enough the graph is flooded, along
        lists that are near enough, so what is read has no upper limit.
        """
        number = len(self.centroids)
        ids, apart = self.search(queries, min(max(BEAM, least), number))
        limit = ratio * apart[:, 0] + 1e-12
        seen = np.zeros((len(queries), number), bool)
        row = np.broadcast_to(np.arange(len(queries))[:, None], ids.shape)
        reached = np.isfinite(apart)
        seen[row[reached], ids[reached]] = True
        taken = np.zeros_like(seen)
        close = apart <= limit[:, None]
        first = close.copy()
        first[:, :least] |= reached[:, :least]
        taken[row[first], ids[first]] = True
        q, k = row[close], ids[close]
        while len(q):
            near = self.graph[k]
            flat = np.repeat(q, near.shape[1]) * number + near.ravel()
            flat = np.unique(flat[~seen.ravel()[flat]])
            q, k = flat // number, flat % number
            seen[q, k] = True
            distance = np.empty(len(q))
            for start in range(0, len(q), 65_536):
                own = slice(start, start + 65_536)
                products = np.einsum("nd,nd->n", queries[q[own]], self.centroids[k[own]])
                distance[own] = np.sqrt(np.maximum(2 - 2 * products, 0))
            close = distance <= limit[q]
            q, k = q[close], k[close]
            taken[q, k] = True
        return np.nonzero(taken)


def matrix(array: pa.Array) -> np.ndarray:
    flat = array.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(array), -1)


def post(indexes: dict[int, tuple[int, Index]], keep: int | None, ratio: float, least: int = 1):
    """(vid, v) → one row per list that is near enough: (list, vid, v).

    At most ``keep`` lists, all that are near enough without it; the ``least`` nearest
    at any distance. ``indexes`` has the first list and the index by the length of
    vectors; those of a length without an index share one list.
    """

    def lists_of(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        length = v.shape[1]
        if length not in indexes:
            return np.arange(len(v)), np.full(len(v), -length)
        offset, index = indexes[length]
        rows, lists = [], []
        step = max(16, min(1024, WALK // len(index.centroids)))
        for start in range(0, len(v), step):
            own = unit(v[start : start + step])
            if keep:
                ids, apart = index.search(own, keep)
                near = np.isfinite(apart) & (apart <= ratio * apart[:, :1] + 1e-12)
                near[:, :least] |= np.isfinite(apart[:, :least])
                row, at = np.nonzero(near)
                found = ids[row, at]
            else:
                row, found = index.within(own, ratio, least)
            rows.append(start + row)
            lists.append(offset + found)
        return np.concatenate(rows), np.concatenate(lists)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            lengths = pc.list_value_length(whole.column("v")).to_numpy(zero_copy_only=False)
            for length in np.unique(lengths):
                same = whole.take(pa.array(np.flatnonzero(lengths == length)))
                for start in range(0, same.num_rows, 1024):
                    batch = same.slice(start, 1024)
                    row, lists = lists_of(matrix(batch.column("v")))
                    # few rows at a time: a query may be sent to many lists
                    for few in range(0, len(row), 8192):
                        taken = batch.take(pa.array(row[few : few + 8192]))
                        ids = pa.array(lists[few : few + 8192].astype(np.int32))
                        yield pa.RecordBatch.from_arrays(
                            [ids, taken.column("vid"), taken.column("v")], names=["list", "vid", "v"]
                        )

    return run


def nearest_in_block(keep: int):
    """Queries and vectors of one block → the ``keep`` nearest of each query, exactly scored."""

    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if queries.num_rows and vectors.num_rows:
            order = np.argsort(vectors["vid"].to_numpy(), kind="stable")
            vid, qid = vectors["vid"].to_numpy()[order], queries["vid"].to_numpy()
            v, q = matrix(vectors["v"].combine_chunks())[order], matrix(queries["v"].combine_chunks())
            vn, qn = (np.sqrt((x * x).sum(axis=1)) for x in (v, q))
            take = min(len(v), keep)
            directions = unit(v).T
            for start in range(0, len(q), 256):
                part = slice(start, start + 256)
                rough = unit(q[part]) @ directions
                least = -np.partition(-rough, take - 1, axis=1)[:, take - 1]
                row, at = np.nonzero(rough >= least[:, None] - MARGIN)
                score = np.empty(len(row))
                for few in range(0, len(row), 65_536):
                    own = slice(few, few + 65_536)
                    r, k = start + row[own], at[own]
                    # one row at a time, so that equal vectors get equal scores
                    score[own] = (q[r] * v[k]).sum(axis=1) / (qn[r] * vn[k])
                order = np.lexsort((vid[at], -score, row))
                row, at, score = row[order], at[order], score[order]
                best = np.arange(len(row)) - np.searchsorted(row, row) < take
                out[0].append(qid[start + row[best]])
                out[1].append(vid[at[best]])
                out[2].append(score[best])
        columns = [np.concatenate(x) if x else np.zeros(0) for x in out]
        types = (pa.int64(), pa.int64(), pa.float64())
        return pa.table({n: pa.array(x.astype(t.to_pandas_dtype())) for n, x, t in zip(("qid", "vid", "score"), columns, types)})

    return run


def usable(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(id, v) of the vectors that take part, equal rows once."""
    v = column(vector)
    rows = df.select(column(vec_id).cast("long").alias("id"), v.alias("v")).where(
        "id IS NOT NULL AND v IS NOT NULL AND size(v) > 0"
    )
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(~F.coalesce(bad, F.lit(True)) & F.exists("v", lambda x: x != 0))
    return rows.distinct()


def lists_by_length(counts: dict[int, int]) -> dict[int, int]:
    """Number of lists for the vectors of each length; lengths that one list serves are left out.

    ``INDEX_BYTES`` are shared in proportion to the number of vectors.
    """
    every = sum(counts.values())
    lists = {d: min(math.ceil(n / LIST), int(INDEX_BYTES * n / every / (8 * d))) for d, n in counts.items()}
    return {d: k for d, k in lists.items() if k > 1}


def fit_indexes(points: DataFrame) -> dict[int, tuple[int, Index]]:
    """First list and index by length of vectors, fitted on a bounded sample of (vid, v)."""
    lengths = points.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()
    counts = {r["d"]: r["n"] for r in lengths}
    lists = lists_by_length(counts)
    indexes, offset = {}, 0
    for d, number in sorted(lists.items()):
        aimed = max(SAMPLE, PER_LIST * number)
        share = int(min(1.0, aimed / counts[d]) * 1_000_000) + 1
        some = points.where((F.size("v") == d) & (F.pmod(F.xxhash64("vid"), F.lit(1_000_000)) < share))
        fitted = some.select("v").limit(2 * aimed).toArrow()
        if not fitted.num_rows:
            continue
        index = Index.fit(unit(matrix(fitted["v"].combine_chunks())), min(number, fitted.num_rows))
        indexes[d] = offset, index
        offset += len(index.centroids)
    return indexes


def nearest(
    df: DataFrame, queries: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", keep: int = 5,
) -> DataFrame:
    """Per query its ``keep`` nearest other vectors found: query_id, rank, vec_id, score.

    Score: cosine in double precision on the vectors as given; ties go to the smaller
    id. Null ids and vectors that are null, zero, or hold a null or non-finite component
    take no part. A cosine needs two vectors of one length, so a query finds those of its
    own length, each length having lists of its own; a length that one list serves is
    searched whole. Equal rows count once; a query never finds its own id. Equal vectors are one point of the index with the
    ``keep`` + 1 smallest of their ids, which is all that an answer can hold. An empty
    table gives an empty table.
    """
    rows = pin(usable(df, vec_id, vector).withColumn("h", F.xxhash64("v")))
    # Spark keeps the first ids of a vector in every task before it moves rows
    same = W.partitionBy("h", "v").orderBy("id")
    first = rows.withColumn("k", F.row_number().over(same)).where(F.col("k") <= keep + 1)
    points = first.groupBy("h", "v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    points = pin(points.withColumn("vid", F.col("ids")[0]))
    asked = queries.select(column(vec_id).cast("long").alias("id")).distinct()
    wanted = rows.join(asked, "id", "left_semi").select(F.col("id").alias("query_id"), "h", "v")
    wanted = skewed_join(wanted, points.select("h", "v", "vid"), ["h", "v"], "inner")
    wanted = pin(wanted.select("query_id", F.col("vid").alias("qid")))

    indexes = fit_indexes(points)
    kind = points.schema["v"].dataType.simpleString()
    schema = f"list int, vid long, v {kind}"
    slim = points.select("vid", "v")
    posted = pin(slim.mapInArrow(post(indexes, COPIES, COPY_RATIO), schema))
    ids = wanted.select(F.col("qid").alias("vid")).distinct()
    probes = pin(slim.join(ids, "vid", "left_semi").mapInArrow(post(indexes, None, PROBE_RATIO, LEAST_PROBES), schema))

    def cut(frame, name):
        size = F.sum(F.size("v") * F.lit(8).cast("long"))
        return frame.groupBy("list").agg(F.ceil(size / BLOCK_BYTES).cast("int").alias(name))

    blocks = cut(posted, "vs").join(cut(probes, "qs"), "list")

    def tiles(frame, mine, others, own, every):
        """Each row goes to its own block and meets all blocks of the other side."""
        placed = skewed_join(frame, blocks, ["list"], "inner")
        placed = placed.withColumn(own, F.pmod(F.xxhash64("vid"), F.col(mine)).cast("int"))
        return placed.select("list", "vid", "v", own, F.explode(F.sequence(F.lit(0), F.col(others) - 1)).alias(every))

    left = tiles(probes, "qs", "vs", "q", "p").groupBy("list", "q", "p")
    right = tiles(posted, "vs", "qs", "p", "q").groupBy("list", "q", "p")
    found = left.cogroup(right).applyInArrow(nearest_in_block(keep + 1), "qid long, vid long, score double")
    found = found.dropDuplicates(["qid", "vid"])
    best = W.partitionBy("qid").orderBy(F.desc("score"), "vid")
    found = found.withColumn("k", F.row_number().over(best)).where(F.col("k") <= keep + 1)
    found = found.join(points.select("vid", "ids"), "vid").select("qid", "score", F.explode("ids").alias("vec_id"))
    answers = skewed_join(wanted, found, ["qid"], "inner").where("vec_id != query_id")
    answers = answers.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    answers = answers.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)
    return answers.select("query_id", "rank", "vec_id", "score")
