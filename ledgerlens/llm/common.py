"""What the corpus operators share: table reading, Arrow helpers, mixing, components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import ensure_checkpoint_dir, pin

#: texts handled together inside one Arrow batch, by characters
SLICE_CHARS = 2_000_000
#: edges that a task reduces to a forest at once
FOREST_EDGES = 300_000
#: largest table of ids that is sent to every executor, in bytes
BROADCAST_BYTES = 16_000_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """New folder beside the checkpoints, which all executors share; it goes with the session's JVM."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(path)
    store.deleteOnExit(path)
    return folder


def column(name: str):
    """Column by its literal name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def slices(texts: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, list[str | None]]]:
    """Texts of a batch in runs of about ``SLICE_CHARS``, with the offset of each run.

    Only one run at a time becomes Python strings, so a batch of long texts needs
    little more memory than its Arrow form.
    """
    sizes = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + SLICE_CHARS, "right")))
        yield start, texts.slice(start, stop - start).to_pylist()
        start = stop


def frugal(function: Callable[[Iterator], Iterator], release: Callable[[], None] | None = None):
    """Function for ``mapInArrow`` whose worker keeps no Arrow memory that it has freed.

    Arrow's allocator holds on to freed memory, several hundred MB after long results, and
    workers go on to other tasks and stages. It goes back after every result and at the
    end of a task, where ``release`` first drops what the function keeps.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for made in function(batches):
                yield made
                del made
                pa.default_memory_pool().release_unused()
        finally:
            if release:
                release()
            pa.default_memory_pool().release_unused()

    return run


def map_texts(
    df: DataFrame,
    keep: dict[str, str],
    text: str,
    function: Callable[[list[str | None]], list],
    schema: str,
    release: Callable[[], None] | None = None,
) -> DataFrame:
    """One row out per row in: kept columns plus what ``function`` makes of the texts.

    ``keep`` maps output names to input columns; only these and the text are read.
    ``function`` gets texts and returns one sequence per column of ``schema``. It is
    built once per task from a picklable callable. ``release`` runs at the end of each
    task and drops what the function keeps, as a worker goes on to other tasks.
    """
    frame = df.select(*(column(c).alias(n) for n, c in keep.items()), column(text).alias("_text"))
    kept = [frame.schema[n] for n in keep]
    declared = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    full = f"{declared}, {schema}" if declared else schema
    out = df.sparkSession.createDataFrame([], full).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)
    new = [f.name for f in out.fields][len(kept):]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("_text")
            for start, run_of in slices(texts):
                part = batch.slice(start, len(run_of))
                made = function(run_of)
                arrays = [part.column(n).cast(arrow.field(n).type) for n in keep]
                arrays += [pa.array(v, type=arrow.field(n).type) for n, v in zip(new, made)]
                del made
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return frame.mapInArrow(frugal(run, release), out)


MASK = (1 << 64) - 1


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit finaliser (multiply, xor-shift) of unsigned integers, wrapping."""
    x = (x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & MASK)).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def if_small(df: DataFrame, row_bytes: int) -> DataFrame:
    """Pinned side of a join: sent to every executor only if its counted rows fit.

    Beyond ``BROADCAST_BYTES`` the join stays a shuffle join.
    """
    pinned = pin(df)
    return F.broadcast(pinned) if pinned.count() * row_bytes <= BROADCAST_BYTES else pinned


def skewed_join(left: DataFrame, right: DataFrame, on: list[str], how: str) -> DataFrame:
    """Join with plain shuffles on both sides, so that Spark can split a hot key."""
    digest = F.xxhash64(*on)
    joined = left.withColumn("_h", digest).join(right.withColumn("_h", digest), ["_h", *on], how)
    return joined.drop("_h")


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) of a partition → every vertex with the smallest one it reaches there.

    Works on ``FOREST_EDGES`` edges at a time, so that memory is bounded; what meets
    over the borders of these runs is left to the joins.
    """
    parent: dict[int, int] = {}
    edges = 0

    def find(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(up, up)
        return x

    def stars() -> pa.RecordBatch:
        rows = [(x, find(x)) for x in list(parent)]
        kept = [r for r in rows if r[0] != r[1]]
        columns = [pa.array([r[k] for r in kept], pa.int64()) for k in (0, 1)]
        return pa.RecordBatch.from_arrays(columns, names=["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
        edges += batch.num_rows
        if edges >= FOREST_EDGES:
            yield stars()
            parent.clear()
            edges = 0
    yield stars()


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): rows (node, component), smallest id wins.

    Each round hooks every vertex to its smallest neighbour and contracts the graph;
    vertices that keep a larger neighbour disappear, so that the edges shrink by a
    constant factor. Before a round every task replaces its edges by a spanning forest
    of stars, which leaves few rounds. Only vertices of edges get a row. Nothing is
    collected, and no task gathers a component.
    """

    def slim(found: DataFrame) -> DataFrame:
        return pin(found.where("a != b").distinct().mapInArrow(forest, "a long, b long"))

    pairs = slim(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    labels = nodes.withColumn("component", F.col("node"))
    while not pairs.isEmpty():
        near = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = near.groupBy("a").agg(F.min("b").alias("m"))
        hook = pin(hook.select("a", F.least("a", "m").alias("m")))
        moved = labels.withColumnRenamed("component", "a")
        moved = skewed_join(moved, hook, ["a"], "left")
        labels = moved.select("node", F.coalesce("m", "a").alias("component"))
        other = hook.select(F.col("a").alias("b"), F.col("m").alias("n"))
        moved = skewed_join(skewed_join(pairs, hook, ["a"], "inner"), other, ["b"], "inner")
        moved = moved.select(F.greatest("m", "n").alias("a"), F.least("m", "n").alias("b"))
        pairs = slim(moved)
    return pin(labels)
