"""Exact self-join of documents on the Jaccard similarity of their word n-grams.

1. Documents with equal sets form classes; the smallest id of each goes on.
2. The n-grams of all texts have one order: those that few texts seem to hold come first,
   by counts in hashed cells. Two linked sets share ``SHARED`` of their first n-grams at
   least, whatever the order (see ``Bands``); a good order only keeps chance and boilerplate
   out of them. Documents that share so many are candidates, and so are all that share one
   n-gram with more than ``FEW`` others. These go into the same candidate group.
3. Candidate groups are cut into *tiles*: pairs of blocks of neighbouring sizes. In a
   tile hashed bitmaps bound each pair's overlap from above (a bit that only one side
   has is an element that only it has); the sorted hash arrays of the surviving pairs
   are intersected exactly. A tile reports a spanning forest of its links.
4. Links and classes are joined into components.

No pair of documents leaves a tile unless it links two groups of it, and no group is
gathered in one task: a large one has many tiles.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import pin
from .bpe import Memory
from .common import BROADCAST_BYTES, column, components, frugal, if_small, map_texts, mix, skewed_join, slices

#: groups up to this size are one tile; most documents of a block (a tile has two)
TILE, TILE_MOST = 64, 4096
BITS_MOST = 1 << 16
#: first n-grams that linked sets have in common, at least
SHARED = 4
#: documents of a key up to which their pairs are counted; beyond, all of them are linked
FEW = 16
#: cells in which n-grams are counted for their order, as a power of two, and parts of them
CELL_BITS, PARTS = 20, 64


@lru_cache(maxsize=1)
def word_hashes() -> Memory:
    return Memory(xxhash.xxh3_64_intdigest)


def release() -> None:
    word_hashes.cache_clear()


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted hashes of the distinct word n-grams; a shorter text is one of its own length.

    A-Z is lower-cased, words are separated by ASCII white space.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(word_hashes().__getitem__, words), np.uint64, len(words))
    width = min(size, len(words))
    number = len(words) - width + 1
    out = hashes[:number] + np.uint64(width)
    for k in range(1, width):
        out = mix(out) + hashes[k : k + number]
    return np.unique(mix(out))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def cells(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def rare_first(hashes: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """A set in the order that all sets share: by the level of its n-grams, then by hash."""
    return hashes[np.argsort(levels[cells(hashes)], kind="stable")]


class Bands:
    """Size bands, and how many first elements of a set a linked set has some of.

    ``percent``: two sets link if 100 · overlap ≥ percent · union. Sets that share o
    elements share k at least of their first size - o + k ones, in any order common to
    both: if fewer, take the set whose first ones end earlier in that order; o - k
    elements of it stand behind them, so that it would share less than o in all.
    """

    def __init__(self, percent: int, ratio: float = 1.5):
        self.percent = percent
        self.lows = [1]
        while self.lows[-1] < 1 << 40:
            self.lows.append(max(self.lows[-1] + 1, math.ceil(self.lows[-1] * ratio)))

    def of(self, size: int) -> int:
        return int(np.searchsorted(self.lows, size, "right")) - 1

    def overlap(self, size: int, other: int) -> int:
        """Fewest elements that linked sets of these sizes share."""
        return -(-(size + other) * self.percent // (100 + self.percent))

    def shared(self, band: int) -> int:
        """First elements that linked sets share, the smaller of which is in the band; 0: only equal sets link."""
        small = self.lows[band + 1] - 1
        if small * 100 // self.percent == small and self.overlap(small, small) == small:
            return 0
        return SHARED if self.overlap(self.lows[band], self.lows[band]) >= SHARED else 1

    def keys(self, ordered: np.ndarray) -> list[np.ndarray]:
        """Keys of a set's first elements, for each band that a linked pair of it may be in.

        Its lowest bit says whether a single common key makes two sets candidates.
        """
        size, out = len(ordered), []
        for band in range(self.of(-(-size * self.percent // 100)), self.of(size) + 1):
            shared = self.shared(band)
            if not shared:
                continue
            least = max(self.lows[band], -(-size * self.percent // 100))
            first = ordered[: size - self.overlap(size, least) + shared]
            out.append(mix(first, 100 + band) & ~np.uint64(1) | np.uint64(shared == 1))
        return out


def feature_rows(size: int):
    """(doc_id, text) batches → n, d1, d2 per row: number of n-grams and a 128-bit digest of the set.

    Then, without n, the task's number of texts with an n-gram of each cell, in parts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << CELL_BITS, np.uint32)
        schema = pa.schema([*((c, pa.int64()) for c in ("doc_id", "n", "d1", "d2")), ("part", pa.int32()), ("counts", pa.binary())])
        for batch in batches:
            for start, texts in slices(batch.column("_text")):
                sets = [shingles(t, size) for t in texts]
                columns = [batch.column("doc_id").slice(start, len(texts)), pa.array([len(s) for s in sets], pa.int64())]
                for k in (1, 2):
                    digests = [int(signed(mix(s, 10 + k).sum(keepdims=True))[0]) if len(s) else None for s in sets]
                    columns.append(pa.array(digests, pa.int64()))
                columns += [pa.nulls(len(texts), pa.int32()), pa.nulls(len(texts), pa.binary())]
                counts += np.bincount(cells(np.concatenate(sets)), minlength=len(counts)).astype(np.uint32)
                yield pa.RecordBatch.from_arrays(columns, schema=schema)
        packed = [zlib.compress(part.tobytes(), 1) for part in counts.reshape(PARTS, -1)] if counts.any() else []
        none = pa.nulls(len(packed), pa.int64())
        columns = [none] * 4 + [pa.array(range(len(packed)), pa.int32()), pa.array(packed, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def sum_counts(part: pa.Table) -> pa.Table:
    """All tasks' counts of a part → one row."""
    total = np.zeros((1 << CELL_BITS) // PARTS, np.uint64)
    for packed in part["counts"]:
        total += np.frombuffer(zlib.decompress(packed.as_py()), np.uint32)
    return pa.table({"part": part["part"][:1], "counts": pa.array([total.tobytes()], pa.binary())})


def cell_levels(counted: DataFrame) -> np.ndarray:
    """Level of each cell, 2 MB however large the table: the root of its count.

    Roots of counts vary by chance about equally in cells of few and of many n-grams.
    """
    levels = np.zeros((PARTS, (1 << CELL_BITS) // PARTS), np.uint16)
    summed = counted.groupBy("part").applyInArrow(sum_counts, "part int, counts binary")
    for row in summed.collect():  # one per part
        counts = np.frombuffer(bytes(row["counts"]), np.uint64)
        levels[row["part"]] = np.minimum(2 * np.sqrt(counts), 65535)
    return levels.ravel()


def local_stars(keys: np.ndarray, owners: np.ndarray) -> pa.RecordBatch:
    """(key, node) pairs → the same; of a key with more than ``FEW`` the first node and links of the others to it.

    A row without ``head`` still has to meet its key's other rows; ``many`` says that its key
    has had links. A link (head, node) is settled, once however many keys agree; its key
    only spreads it over the tasks.
    """
    unique, first, place, number = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    heads, many = owners[first][place], number > FEW
    links = np.unique(np.stack([heads, owners])[:, many[place] & (heads != owners)], axis=1)
    spread = mix(mix(links[0].view(np.uint64), 20) ^ links[1].view(np.uint64), 21)
    plain = ~many[place]
    plain[first] = True
    rest = int(plain.sum())
    settled = np.arange(rest + links.shape[1]) >= rest
    return pa.RecordBatch.from_arrays(
        [
            pa.array(signed(np.concatenate([keys[plain], spread]))),
            pa.array(np.concatenate([owners[plain], links[1]])),
            pa.array(np.concatenate([owners[plain], links[0]]), mask=~settled),
            pa.array(np.concatenate([many[place][plain], settled[rest:]])),
        ],
        names=["key", "node", "head", "many"],
    )


def key_rows(size: int, percent: int, levels: np.ndarray):
    """(node, text) batches → (key, node, head, many) rows; frequent keys are combined within each run of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent)
        for batch in batches:
            nodes = batch.column("node").to_numpy(zero_copy_only=False)
            for start, texts in slices(batch.column("_text")):
                keys, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
                for node, text in zip(nodes[start:], texts):
                    for own in bands.keys(rare_first(shingles(text, size), levels)):
                        keys.append(own)
                        owners.append(np.full(len(own), node, np.int64))
                yield local_stars(np.concatenate(keys), np.concatenate(owners))
        release()

    return run


def candidate_links(keyed: DataFrame) -> DataFrame:
    """Rows of ``key_rows`` → links (a, b) that connect the documents of each candidate group."""
    key = Window.partitionBy("key")
    open_node = F.when(F.col("head").isNull(), F.col("node"))
    met = keyed.withColumns({
        "c": F.count(open_node).over(key), "least": F.min(open_node).over(key), "much": F.bool_or("many").over(key),
    }).where("head IS NOT NULL OR c > 1")
    enough = F.col("head").isNotNull() | F.col("much") | (F.col("c") > FEW) | (F.col("key").bitwiseAND(1) == 1)
    met = met.select("key", "node", F.coalesce("head", "least").alias("first"), F.when(enough, F.col("node")).alias("alone"))
    # the rows of a key are together already; a frequent key's are not gathered
    met = met.groupBy("key", "alone", "first").agg(F.collect_set("node").alias("nodes"))
    pairs = F.flatten(F.transform("nodes", lambda x, i: F.transform(
        F.slice("nodes", F.lit(1), i), lambda y: F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"), F.lit(1).alias("w")))))
    single = F.array(F.struct(F.col("first").alias("a"), F.col("alone").alias("b"), F.lit(SHARED).alias("w")))
    linked = met.select(F.inline(F.when(F.col("alone").isNull(), pairs).otherwise(single))).where("a != b")
    return linked.groupBy("a", "b").agg(F.sum("w").alias("w")).where(F.col("w") >= SHARED).select("a", "b")


def set_bytes(size: int):
    def run(texts):
        sets = [shingles(t, size) for t in texts]
        return [len(s) for s in sets], [s.tobytes() for s in sets]

    return run


def bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """Hashed bitmaps of equal width, about two bits per element of the largest set."""
    most = max(len(s) for s in sets)
    bits = min(BITS_MOST, max(64, 1 << (2 * most - 1).bit_length()))
    out = np.zeros((len(sets), bits // 64), np.uint64)
    for k, own in enumerate(sets):
        place = mix(own, 5) & np.uint64(bits - 1)
        np.bitwise_or.at(out[k], (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63)))
    return out


def tile_links(percent: int):
    """Rows of a tile → links (a, b) that span its linked documents.

    ``side``: 0 and 1 are compared with each other, 2 with all others.
    """

    def linked(overlap, sizes):
        return 100 * overlap >= percent * (sizes - overlap)

    def run(tile: pa.Table) -> pa.Table:
        tile = tile.sort_by([("n", "ascending"), ("node", "ascending")])
        nodes = tile["node"].to_numpy()
        sizes, side = tile["n"].to_numpy(), tile["side"].to_numpy()
        sets = [np.frombuffer(s, np.uint64) for s in tile["hashes"].to_pylist()]
        bits, roots = bitmaps(sets), np.arange(len(sets))
        found: tuple[list, list] = ([], [])
        for i in range(len(sets)):
            end = int(np.searchsorted(sizes, sizes[i] * 100 // percent, "right"))
            if end <= i + 1:
                continue
            later = slice(i + 1, end)
            open_pairs = (roots[later] != roots[i]) & ((side[later] == 2) | (side[later] != side[i]))
            own = np.flatnonzero(open_pairs) + i + 1
            if not len(own):
                continue
            others = bits[own]
            only_i = np.bitwise_count(bits[i] & ~others).sum(axis=1, dtype=np.int64)
            only_j = np.bitwise_count(others & ~bits[i]).sum(axis=1, dtype=np.int64)
            most = np.minimum(sizes[i] - only_i, sizes[own] - only_j)
            for j in own[linked(most, sizes[i] + sizes[own])]:
                if roots[i] == roots[j]:
                    continue
                overlap = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if linked(overlap, sizes[i] + sizes[j]):
                    roots[roots == roots[j]] = roots[i]
                    found[0].append(nodes[i])
                    found[1].append(nodes[j])
        return pa.table({"a": pa.array(found[0], pa.int64()), "b": pa.array(found[1], pa.int64())})

    return run


def tiles_of(members: DataFrame, percent: int) -> DataFrame:
    """(component, node, n) → component, node, n and the tiles (t, side) each row is in.

    A group no larger than a task's share of all rows is one tile. A larger one is cut
    into size bands, and a band into blocks; every two blocks of a band are a tile, and
    so are blocks of neighbouring bands, with those rows that reach over the border.
    The copies of a row grow with the number of blocks, the tiles with its square: the
    square root of a band's share of the tasks suffices to spread it over them. Blocks
    never exceed ``TILE_MOST`` rows.
    """
    spark = members.sparkSession
    lows = [1]
    while lows[-1] < 1 << 40:
        lows.append(max(2 * lows[-1], lows[-1] * 100 // percent + 1))
    edges = F.array(*[F.lit(x).cast("long") for x in lows])
    sized = pin(members.withColumn("band", F.size(F.filter(edges, lambda x: x <= F.col("n")))))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    every = max(sized.count(), 1)
    counts = sized.groupBy("component", "band").agg(F.count("*").alias("c"))
    spread = F.sqrt(F.col("c") * F.lit(2.0 * tasks / every))
    number = F.ceil(F.greatest(F.least(spread, F.col("c") / 16), F.col("c") / TILE_MOST)).cast("int")
    info = counts.groupBy("component").agg(
        F.sum("c").alias("total"),
        F.map_from_entries(F.collect_list(F.struct("band", number.alias("blocks")))).alias("blocks"),
    )
    rows = skewed_join(sized, info, ["component"], "inner")
    here, own, n = F.col("band"), F.col("own"), F.col("n")

    def blocks_at(which):
        return F.coalesce(F.element_at("blocks", which), F.lit(0))

    def places(number):
        return F.when(number > 0, F.sequence(F.lit(0), number - 1)).otherwise(F.array().cast("array<int>"))

    def tile(b1, i, b2, j, side):
        return F.struct(F.concat_ws("-", b1, i, b2, j).alias("t"), side.cast("int").alias("side"))

    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), blocks_at(here)).cast("int"))
    up = F.floor(n * 100 / percent) >= F.element_at(edges, here + 1)
    down = n * percent <= 100 * (F.element_at(edges, here) - 1)
    same = F.transform(places(blocks_at(here)), lambda j: tile(
        here, F.least(own, j), here, F.greatest(own, j),
        F.when(own < j, 0).when(own > j, 1).otherwise(2)))
    above = F.transform(places(F.when(up, blocks_at(here + 1)).otherwise(0)),
                        lambda j: tile(here, own, here + 1, j, F.lit(0)))
    below = F.transform(places(F.when(down, blocks_at(here - 1)).otherwise(0)),
                        lambda j: tile(here - 1, j, here, own, F.lit(1)))
    single = F.array(F.struct(F.lit("-").alias("t"), F.lit(2).alias("side")))
    share = max(TILE, min(every // (2 * tasks), TILE_MOST))
    tiles = F.when(F.col("total") <= share, single).otherwise(F.concat(same, above, below))
    return rows.select("component", "node", "n", tiles.alias("tiles"))


def similar_groups(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 4, percent: int = 85
) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest id reachable by links).

    Links: 100 · overlap ≥ percent · union of the sets of word n-grams; a text with
    fewer words is one n-gram, one without words links with nothing. Rows with one and
    the same id are one document, whatever their texts. Rows without an id get no
    component. Repeated rows stay repeated; an empty table gives an empty table. Ids are
    integers (cast to long). Equality of n-grams is equality of their 64-bit hashes.
    """
    docs = docs.select(column(doc_id).cast("long").alias(doc_id), column(text).alias(text))
    texts = docs.select(column(doc_id).alias("doc_id"), column(text).alias("_text"))
    known = "doc_id long, n long, d1 long, d2 long, part int, counts binary"
    known = pin(texts.mapInArrow(frugal(feature_rows(size), release), known))
    base = known.where("n IS NOT NULL").select("doc_id", "n", "d1", "d2")
    named = base.where("doc_id IS NOT NULL AND n > 0")
    classes = named.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("c"))
    classes = pin(classes.where("c > 1").select("d1", "d2", "rep"))
    copies = skewed_join(named, classes, ["d1", "d2"], "inner").where("doc_id != rep")
    copies = pin(copies.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    again = named.groupBy("doc_id").count().where("count > 1").select("doc_id")
    left_out = copies.select(F.col("a").alias("doc_id")).join(again, "doc_id", "left_anti")

    texts = texts.withColumnRenamed("doc_id", "node")
    texts = texts.where("node IS NOT NULL AND _text IS NOT NULL")
    left_out = if_small(left_out.select(F.col("doc_id").alias("node")), 16)
    heads = texts.join(left_out, "node", "left_anti")
    levels = cell_levels(known.where("n IS NULL"))
    keyed = heads.mapInArrow(frugal(key_rows(size, percent, levels)), "key long, node long, head long, many boolean")
    stars = candidate_links(keyed)
    groups = components(stars)

    sizes = named.select(F.col("doc_id").alias("node"), "n").distinct()
    placed = pin(tiles_of(groups.join(sizes, "node"), percent))
    copied = placed.agg(F.sum(F.size("tiles"))).first()[0] or 0
    wanted = if_small(placed.select("node").distinct(), 16)
    sets = texts.join(wanted, "node", "left_semi")
    sets = map_texts(sets, {"node": "node"}, "_text", set_bytes(size), "n long, hashes binary", release)
    if copied * 64 <= BROADCAST_BYTES:  # about what the table of tiles takes in a task
        placed = F.broadcast(placed)
    tiles = sets.join(placed, ["node", "n"]).select("component", F.inline("tiles"), "node", "n", "hashes")
    tiles = tiles.groupBy("component", "t")
    links = tiles.applyInArrow(tile_links(percent), "a long, b long")
    linked = components(links.unionByName(copies))
    out = base.join(linked.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")
    )


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 4, percent: int = 85) -> DataFrame:
    """One document of each group of linked ones: that with the smallest id.

    Rows without an id stay. Of several rows with one id one stays.
    """
    groups = similar_groups(docs, doc_id, text, size, percent).where("doc_id IS NOT NULL")
    groups = groups.groupBy("doc_id").agg(F.min("component_id").alias("c"), F.count("*").alias("n"))
    groups = pin(groups)
    gone = if_small(groups.where("doc_id != c").select("doc_id"), 16)
    gone = gone.select(F.col("doc_id").alias(doc_id))
    kept = docs.join(gone, doc_id, "left_anti")
    if groups.where("n > 1 AND doc_id = c").isEmpty():
        return kept
    unnamed = kept.where(column(doc_id).isNull())
    return kept.where(column(doc_id).isNotNull()).dropDuplicates([doc_id]).unionByName(unnamed)
