"""URL rules on hosts and paths: sorted sweep over reversed-host keys."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import pin
from .common import column

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, in lower case."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 1)
    return F.translate(host, UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 2)


def keys_of(host: Column, path: Column, labels: int, length: int) -> Column:
    """Canonical keys of a URL: last 1, 2, … labels reversed, ``#``, path.

    A host has no ``#``, so a rule's key is a prefix of one of these keys just if the
    rule fits. More labels or characters than the longest rule has cannot matter.
    """
    back = F.reverse(F.split(host, r"\.", -1))
    count = F.least(F.size(back), F.lit(labels))
    return F.transform(
        F.sequence(F.lit(1), count),
        lambda k: F.substring(F.concat(F.array_join(F.slice(back, 1, k), "."), F.lit("#"), path), 1, length),
    )


def sweep(carried: dict[int, list[tuple[str, str, str]]]):
    """Sorted rows of a partition → longest active rule of every URL key.

    The stack holds the nested rules whose interval covers the current key; what covers
    the first key of a partition from an earlier one is given.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[tuple[str, str, str]] | None = None
        for batch in batches:
            ids, rules, verdicts, lengths = [], [], [], []
            names = ("_part", "_key", "_id", "_rule", "_verdict")
            for part, key, row, rule, verdict in zip(*(batch.column(n).to_pylist() for n in names)):
                if stack is None:
                    stack = list(carried.get(part, []))
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if rule is not None:
                    if not stack or stack[-1][0] != key:
                        stack.append((key, rule, verdict))
                    continue
                top = stack[-1] if stack else ("", None, None)
                ids.append(row)
                lengths.append(len(top[0]))
                rules.append(top[1])
                verdicts.append(top[2])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(lengths, pa.int32()),
                 pa.array(rules, pa.string()), pa.array(verdicts, pa.string())],
                names=["_id", "_length", "rule", "verdict"],
            )

    return run


def judge_urls(
    pages: DataFrame, rules: DataFrame, id_column: str, url: str = "url", default: str = "allow"
) -> DataFrame:
    """Per page: page_id, host, path, the longest fitting rule and its verdict.

    ``rules`` has host, path and verdict. A rule fits its host and all subdomains if the
    URL's path starts with the rule's path. Where no rule fits, ``rule`` is null and the
    verdict is ``default``. Of rules with the same host and path a ``block`` counts; rules
    with a null in host, path or verdict fit nothing. Without ``://`` host and path are
    empty. Repeated pages each get their row, also with equal or null ids; an empty
    table gives an empty table; other columns are not read.

    Pages whose keys equal are spread over partitions. The driver gets one key per
    partition and, for each, the rules that are a prefix of it.
    """
    spark = pages.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    known = rules.where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL")
    host = F.translate(column("host"), UPPER, LOWER)
    known = known.select(
        F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("#"), "path").alias("_key"),
        F.concat(host, "path").alias("_rule"), F.col("verdict").alias("_verdict"),
        F.size(F.split(host, r"\.", -1)).alias("_labels"),
    )
    known = pin(known.groupBy("_key", "_rule", "_labels").agg(F.max("_verdict").alias("_verdict")))
    sizes = known.agg(F.max("_labels"), F.max(F.char_length("_key"))).first()
    labels, length = sizes[0] or 1, sizes[1] or 1
    url_column = column(url)
    base = pages.select(
        column(id_column).alias("page_id"), host_of(url_column).alias("host"),
        path_of(url_column).alias("path"), F.monotonically_increasing_id().alias("_id"),
    )
    base = pin(base)
    points = base.select(
        F.explode(keys_of(F.col("host"), F.col("path"), labels, length)).alias("_key"), "_id"
    )
    empty = F.lit(None).cast("string")
    both = points.select("_key", "_id", empty.alias("_rule"), empty.alias("_verdict")).union(
        known.select("_key", F.lit(-1).cast("long").alias("_id"), "_rule", "_verdict")
    )
    placed = both.repartitionByRange(parts, "_key", "_id").sortWithinPartitions("_key", "_id")
    placed = pin(placed.withColumn("_part", F.spark_partition_id()))
    firsts = placed.groupBy("_part").agg(F.min("_key").alias("_first"))
    prefixes = F.transform(
        F.sequence(F.lit(1), F.char_length("_first")), lambda n: F.substring("_first", 1, n)
    )
    covering = firsts.select("_part", F.explode(prefixes).alias("_key")).join(known, "_key")
    carried = defaultdict(list)
    for r in covering.select("_part", "_key", "_rule", "_verdict").collect():
        carried[r["_part"]].append((r["_key"], r["_rule"], r["_verdict"]))
    carried = {part: sorted(found, key=lambda x: len(x[0])) for part, found in carried.items()}
    schema = "_id long, _length int, rule string, verdict string"
    judged = placed.mapInArrow(sweep(carried), schema)
    best = judged.groupBy("_id").agg(F.max_by(F.struct("rule", "verdict"), "_length").alias("_best"))
    return base.join(best, "_id").select(
        "page_id", "host", "path", F.col("_best.rule").alias("rule"),
        F.coalesce("_best.verdict", F.lit(default)).alias("verdict"),
    )
