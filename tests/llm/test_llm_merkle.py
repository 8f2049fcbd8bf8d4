import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import merkle
from ledgerlens.llm.queries import LLM_QUERIES

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    shown = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row]
    return h(*shown)


def tree(nodes, fanout):
    """(root, siblings of each leaf per level as (left, right)) by plain loops."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run = nodes[i // fanout * fanout : i // fanout * fanout + fanout]
            paths[k].append((run[: i % fanout], run[i % fanout + 1 :]))
        nodes = [h(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
        at = [i // fanout for i in at]
    return nodes[0], paths


def brute(rows, fanout=3):
    """Rows of the query in a sorted list."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    subroots, below = [], []
    for s in order:
        kept = sorted(((r[0] is not None, r[0] or 0, leaf(r), r) for r in groups[s]), key=lambda x: x[:3])
        root, paths = tree([k[2] for k in kept], fanout)
        subroots.append(root)
        below.append((kept, paths))
    root, above = tree(subroots, fanout)
    out = []
    for k, (kept, paths) in enumerate(below):
        for (_, _, node, r), path in zip(kept, paths):
            full = path + above[k]
            odd = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            folded = leaf(r[:4] + (r[4].replace("\n", ""),)) if odd else node
            for left, right in full:
                folded = h(*left, folded, *right)
            proof = h(*(x for left, right in full for x in left + right))
            out.append((r[0], node, subroots[k], root, proof, folded, folded == root))
    return sorted(out, key=repr)


def query(spark, rows, folder, **extra):
    df = spark.createDataFrame(rows, SCHEMA)
    df.withColumns({n: F.lit(v) for n, v in extra.items()}).write.parquet(f"{folder}/documents.parquet")
    found = LLM_QUERIES["op12_merkle_manifest"](spark, str(folder))
    columns = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in found.select(columns).collect()), key=repr)


def test_nulls_repeats_long_texts_and_clashing_names(spark, tmp_path):
    rows = [(i, f"s{i % 3}", "en", 7, f"line {i}\nmore ä €\n") for i in range(40)]
    rows += [(None, "s1", None, None, None), (None, None, "de", 0, ""), (41, None, "", 1, "a\nb" * 50_000)]
    rows += [(5, "s2", "en", 7, "line 5\nmore ä €\n")] * 3 + [(5, "s2", "xx", 7, None), (99, "lone", "en", 1, "x\n")]
    rows += [(100 + i, "", "en", i, "\n") for i in range(9)] + [(200 + i, "é", "en", i, "\n") for i in range(4)]
    found = query(spark, rows, tmp_path, tree="t", at=1, node=None, size="s", path="p", leaf="clash", _row=3)
    assert found == brute(rows)
    assert {r[-1] for r in found} == {True, False}


def test_the_query_on_the_small_tables(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(
        "doc_id", "source", "lang", "n_chars", "text").collect()]
    found = LLM_QUERIES["op12_merkle_manifest"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(map(tuple, found), key=repr) == brute(rows)


def test_empty_table(spark, tmp_path):
    assert query(spark, [], tmp_path) == []


@pytest.mark.parametrize("fanout", [2, 4])
def test_other_fanouts_and_changed_rows(spark, tmp_path, fanout):
    rows = [(i, "all" if i < 17 else f"s{i}", "en", 1, str(i)) for i in range(22)]
    df = spark.createDataFrame(rows, SCHEMA)
    changed = merkle.leaf([F.when(F.col("doc_id") == 3, F.lit(None)).otherwise(F.col("text"))])
    made = merkle.build(df, ["text"], "doc_id", "source", str(tmp_path), {"now": changed}, fanout)
    leaves = {r[0]: leaf((r[4],)) for r in rows}
    first, paths = tree([leaves[i] for i in range(17)], fanout)
    root, _ = tree([first, *(leaves[i] for i in range(17, 22))], fanout)
    assert made.root == root
    found = made.rows.select("doc_id", merkle.text_of(F.col("leaf")), made.verified(F.col("now")), F.size("path")).collect()
    assert {r[0] for r in found if not r[2]} == {3} and {r[0]: r[1] for r in found} == leaves
    above = len(tree([first] + list("abcde"), fanout)[1][0])
    assert {r[0]: r[3] for r in found}[0] == len(paths[0]) + above
