"""Merkle manifest of a dataset: a digest per row, a tree per group, a tree over the groups.

A node's siblings are the others of its run of ``fanout`` consecutive nodes. Each level is
joined with itself on computed sibling indices (index XOR 1 for pairs, slot offsets for
wider runs); after that every node knows its siblings, and the node in slot zero of each
run emits the parent. All trees climb together, so there are as many levels as the largest
tree is high, each a fraction of the one below. Proofs come down the same levels: a node's
path is its own siblings followed by the path of its parent.

No tree is gathered anywhere; join keys are (tree, index), which are unique, so a group
that holds a third of all rows is spread like any other.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import pin
from .common import column, skewed_join
from .sharding import PART_BITS, number_rows

PATH = "array<struct<before:binary,after:binary>>"


def digest(*inputs: Column) -> Column:
    """SHA-256 of the concatenated inputs, as bytes."""
    return F.unhex(F.sha2(F.concat(*(c.cast("binary") for c in inputs)), 256))


def text_of(node: Column) -> Column:
    """Digests (one or several in a row) as lower-case hex."""
    return F.lower(F.hex(node))


def field(value: Column) -> Column:
    """A field of a leaf: ``-`` if null, else byte count, colon, value."""
    shown = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(shown).cast("string"), F.lit(":"), shown), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    """Digest of a row's fields, as bytes. Lengths keep neighbouring fields apart."""
    return digest(*(field(v) for v in values))


def with_siblings(nodes: DataFrame, fanout: int) -> DataFrame:
    """``before`` and ``after``: digests of the siblings on the left and on the right.

    ``nodes`` has tree, at, size (nodes of the tree on this level), node and maybe more.
    """
    slot = F.pmod("at", F.lit(fanout))
    joined = nodes
    for k in range(1, fanout):
        if fanout == 2:
            place = F.col("at").bitwiseXOR(1)
        else:
            place = F.col("at") - slot + F.pmod(slot + k, F.lit(fanout))
        other = nodes.select(
            F.col("tree").alias("_tree"), F.col("at").alias("_at"), F.col("node").alias(f"_node{k}")
        )
        joined = joined.withColumn("_place", place)
        on = (F.col("tree") == F.col("_tree")) & (F.col("_place") == F.col("_at"))
        joined = joined.join(other.hint("merge"), on, "left").drop("_tree", "_at", "_place")
    nothing = F.lit(b"")

    def side(left: bool) -> Column:
        """Siblings in order: offset k leads to slot + k, or around to the left end."""
        made = F.lit(None).cast("binary")
        for s in range(fanout):
            steps = range(fanout - s, fanout) if left else range(1, fanout - s)
            found = [F.coalesce(F.col(f"_node{k}"), nothing) for k in steps]
            made = F.when(slot == s, F.concat(nothing, *found)).otherwise(made)
        return made

    return joined.select(*nodes.columns, side(True).alias("before"), side(False).alias("after"))


def parents(level: DataFrame, fanout: int) -> DataFrame:
    """The nodes above: slot zero of each run holds the run's digests in order."""
    first = level.where((F.col("size") > 1) & (F.pmod("at", F.lit(fanout)) == 0))
    return first.select(
        "tree",
        F.expr(f"at div {fanout}").alias("at"),
        F.expr(f"(size + {fanout - 1}) div {fanout}").alias("size"),
        digest(text_of(F.concat("node", "after"))).alias("node"),
    )


def climb(nodes: DataFrame, largest: int, fanout: int, folder: str) -> list[DataFrame]:
    """Levels, bottom first, of trees of at most ``largest`` leaves, as tables in a folder.

    A level holds the trees that reach it, a finished one with its root (size 1). The
    next level and the way down read it. Tables and not checkpoints: a checkpoint keeps
    Spark's size estimate of its plan, and estimates of self-joins multiply per level.
    The joins merge sorted sides, as a broadcast per level would add up on the driver.
    """
    spark, levels = nodes.sparkSession, []
    while True:
        path = f"{folder}/level-{len(levels)}"
        with_siblings(nodes, fanout).write.parquet(path)
        levels.append(spark.read.parquet(path))
        if largest <= 1:
            return levels
        nodes = parents(levels[-1], fanout)
        largest = -(-largest // fanout)


def roots(levels: list[DataFrame]) -> DataFrame:
    """(tree, height, node) of each tree's root."""
    found = [
        level.where("size = 1").select("tree", F.lit(k).alias("height"), "node")
        for k, level in enumerate(levels)
    ]
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def descend(levels: list[DataFrame], tops: DataFrame, fanout: int, folder: str) -> DataFrame:
    """Columns of the lowest level, subroot and path of each of its nodes.

    ``tops`` has tree, height, subroot and the path of each tree's root. The paths of the
    levels above the lowest are tables in the folder, so that every step is a short plan.
    """
    spark, above = tops.sparkSession, None
    for k, level in reversed(list(enumerate(levels))):
        ends = tops.where(F.col("height") == k).select("tree", F.lit(0).cast("long").alias("at"), "subroot", "path")
        kept = ["tree", "at"]
        if not k:
            kept = [c for c in level.columns if c not in ("size", "before", "after")]
            single = level.where("size = 1").select(*kept)
            ends = single.join(ends.drop("at").hint("merge"), "tree").select(*kept, "subroot", "path")
        if above is not None:
            step = F.array(F.struct("before", "after")).cast(PATH).alias("_step")
            up = level.where("size > 1").select(*kept, step, F.expr(f"at div {fanout}").alias("_up"))
            over = above.select(F.col("tree").alias("_tree"), F.col("at").alias("_at"), "subroot", "path")
            on = (F.col("tree") == F.col("_tree")) & (F.col("_up") == F.col("_at"))
            went = up.join(over.hint("merge"), on).select(*kept, "subroot", F.concat("_step", "path").alias("path"))
            ends = ends.union(went)
        above = ends
        if k:
            above.write.parquet(f"{folder}/paths-{k}")
            above = spark.read.parquet(f"{folder}/paths-{k}")
    return above


def number(df: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """Rows with ``_row``, their number in the order (nulls first), and how many there are."""
    placed, offsets, total = number_rows(df, order)
    starts = df.sparkSession.createDataFrame(list(offsets.items()), "_part long, _start long")
    part = F.shiftright("_at", PART_BITS)
    row = F.col("_start") + F.col("_at").bitwiseAND((1 << PART_BITS) - 1)
    joined = placed.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return joined.withColumn("_row", row).drop("_at", "_part", "_start"), total


@dataclass(frozen=True)
class Manifest:
    """``rows``: kept columns, leaf, subroot and path of each row; ``root`` as hex text.

    A path lists the steps from the leaf to the root; each has the siblings in front of
    the node and behind it, as bytes of digests in a row.
    """

    rows: DataFrame
    root: str | None

    def verified(self, node: Column) -> Column:
        """Does a row's digest lead to the root along the row's path?"""
        return folded(node, F.col("path")) == F.lit(self.root)


def folded(node: Column, path: Column) -> Column:
    """Root that follows from a leaf and the siblings of its path, as hex text."""

    def step(inner: Column, siblings: Column) -> Column:
        return digest(text_of(F.concat(siblings["before"], inner, siblings["after"])))

    return text_of(F.aggregate(path, node, step))


def proof(path: Column) -> Column:
    """Digest of a path's siblings from the leaf upwards, left to right, as hex text."""
    joined = F.aggregate(
        path, F.lit(b""), lambda all_, s: F.concat(all_, s["before"], s["after"])
    )
    return F.sha2(text_of(joined).cast("binary"), 256)


def build(
    df: DataFrame,
    values: list[str],
    key: str,
    group: str,
    folder: str,
    keep: dict[str, Column] | None = None,
    fanout: int = 3,
) -> Manifest:
    """Manifest of all rows: a tree per ``group`` in the order of ``key``, one over the groups.

    A leaf is the digest of the row's ``values`` (columns), each preceded by its length.
    Groups are ordered by value, null first; a null key comes first in its group. Rows of
    one key are ordered by their leaves; equal rows are interchangeable. Every row has a
    path of its own, equal ones too. A group of one row has that row's leaf as its
    subroot; a run of one node gets a parent like any other. An empty table has no rows
    and no root. Null, empty and very long values have digests like any others, and other
    columns of ``df`` are not read. ``keep`` adds columns of the input to the result; the
    key is always kept, under its name. ``folder`` gets two tables per level of the trees
    (``groups``) and of the tree over them (``top``): the nodes with their siblings, and
    their paths to the root; the rows of the result read them.
    """
    keep = keep or {}
    slim = df.select(
        column(group).cast("string").alias("_group"),
        column(key).alias("_key"),
        leaf([column(v) for v in values]).alias("node"),
        *(c.alias(f"_keep{k}") for k, c in enumerate(keep.values())),
    )
    numbered, total = number(slim, ["_group", "_key", "node"])
    named = numbered.withColumns(
        {"_none": F.col("_group").isNull(), "_group": F.coalesce("_group", F.lit(""))}
    )
    sizes = named.groupBy("_none", "_group").agg(
        F.min("_row").alias("tree"), F.count(F.lit(1)).alias("size")
    )
    sizes = pin(sizes)
    leaves = skewed_join(named, sizes, ["_none", "_group"], "inner")
    leaves = leaves.withColumn("at", F.col("_row") - F.col("tree")).drop("_row", "_none", "_group")
    facts = sizes.agg(F.max("size").alias("largest"), F.count(F.lit(1)).alias("groups")).first()
    levels = climb(leaves, facts["largest"] or 0, fanout, f"{folder}/groups")

    trees, _ = number(roots(levels).select("tree", "height", "node"), ["tree"])
    trees = pin(trees)
    tops = trees.select(
        F.lit(0).cast("long").alias("tree"),
        F.col("_row").alias("at"),
        F.lit(facts["groups"]).cast("long").alias("size"),
        "node",
        F.col("tree").alias("_of"),
        F.col("height").alias("_height"),
    )
    over = climb(tops, facts["groups"], fanout, f"{folder}/top")
    top = roots(over)
    found = top.select("node").collect()
    start = top.select("tree", "height", F.col("node").alias("subroot"), F.array().cast(PATH).alias("path"))
    ends = descend(over, start, fanout, f"{folder}/top").select(
        F.col("_of").alias("tree"), F.col("_height").alias("height"), F.col("node").alias("subroot"), "path"
    )
    rows = descend(levels, pin(ends), fanout, f"{folder}/groups").select(
        F.col("_key").alias(key),
        *(F.col(f"_keep{k}").alias(name) for k, name in enumerate(keep)),
        F.col("node").alias("leaf"),
        "subroot",
        "path",
    )
    return Manifest(rows, found[0]["node"].hex() if found else None)
