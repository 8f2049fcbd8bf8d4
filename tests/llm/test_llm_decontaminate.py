import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import decontaminate

WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(text, items):
    own, hit, found = words(text), set(), set()
    for item, content in items:
        w = words(content)
        n = min(10, len(w))
        grams = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n and item is not None else set()
        for i in range(len(own) - n + 1 if n else 0):
            if tuple(own[i : i + n]) in grams:
                hit.update(range(i, i + n))
                found.add(str(item))
    sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(own), len(hit), len(found), sha, bool(hit)


def tables(spark):
    draw = random.Random(8)
    vocabulary = [f"w{k}" for k in range(30)] + ["É", "Straße", "x1"]

    def text(n):
        return " ".join(draw.choice(vocabulary) for _ in range(n))

    items = [(i, text(draw.choice([12, 25, 40]))) for i in range(6)]
    items += [(10, items[0][1]), (11, "Short, item!"), (12, ""), (13, None), (None, text(15)), (14, "!!")]
    docs = [(i, text(60)) for i in range(20)]
    docs += [(30, f"a {items[0][1].upper()} b {items[1][1]}"), (31, items[2][1]), (32, "is a SHORT (item) here"),
             (33, None), (34, ""), (35, "..."), (36, items[3][1] + " w1 " * 20000)]
    docs += [(37, items[4][1])] * 3 + [(None, items[4][1])] * 2
    made = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, n_hit int, _w string")
    return docs, items, made, spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("pass_hashes", [None, 30])
def test_hits_equal_brute_force(spark, monkeypatch, pass_hashes):
    """In one pass and in several."""
    if pass_hashes:
        monkeypatch.setattr(decontaminate, "PASS_HASHES", pass_hashes)
    check(spark)


def test_equal_hashes_are_told_apart_by_words(spark, monkeypatch):
    """A hash that only knows the first two words: hits of other words are no hits."""
    monkeypatch.setattr(decontaminate, "hash_at", lambda words, start, size: F.xxhash64(
        *[F.element_at(words, (start + k).cast("int")) for k in range(min(size, 2))]))
    check(spark)


def shape(df):
    text = df._jdf.queryExecution().optimizedPlan().toString()
    return re.findall(r"(?m)^[ :+-]*(\w+)", text)


def test_one_plan_for_one_and_for_many_windows(spark):
    docs, items, df, _ = tables(spark)
    schema = "item_id long, text string"
    target = items[0][1]
    one = spark.createDataFrame([(0, " ".join(target.split()[:10]))], schema)
    many = spark.range(2000).selectExpr(
        "id AS item_id", "concat_ws(' ', transform(sequence(1, 109), k -> concat('v', id, 'x', k))) AS text")
    many = many.union(one)
    plans = []
    for bench, least in ((one, 1), (many, 200_000)):
        windows = decontaminate.pin(decontaminate.test_windows(bench, "item_id", "text", 10))
        assert windows.count() >= least
        hashes = decontaminate.hash_table(windows, [10])
        source = df.select("doc_id", F.col("text").alias("_text"), F.md5(F.col("text").cast("binary")).alias("digest"))
        rows = decontaminate.looked_up(source, ["doc_id"], hashes, [10], True)
        assert rows._jdf.queryExecution().sparkPlan().toString().count("BroadcastHashJoin") == 1
        plans.append(shape(rows))
    assert plans[0] == plans[1]
    want = sorted((str(i), brute(t, [(0, " ".join(target.split()[:10]))])[1]) for i, t in docs)
    found = decontaminate.contamination(df, many).collect()
    assert sorted((str(r["doc_id"]), r["n_hit"]) for r in found) == want


def check(spark):
    docs, items, df, bench = tables(spark)
    found = decontaminate.contamination(df, bench).collect()
    want = [(i, *brute(t, items)) for i, t in docs]
    assert sorted(map(tuple, found), key=repr) == sorted(want, key=repr)
    kept = decontaminate.remove_contaminated(df, bench)
    assert kept.columns == df.columns
    clean = [(i, t) for i, t in docs if not brute(t, items)[-1]]
    assert sorted(map(repr, ((r[0], r[1]) for r in kept.collect()))) == sorted(map(repr, clean))


def test_passes_over_the_documents_agree(spark, monkeypatch):
    folder = "/root/testdata/sf0.01"
    docs, bench = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "benchmark"))
    want = docs.select("doc_id", "text").collect()
    rows = [(str(r["item_id"]), r["text"]) for r in bench.collect()]
    grams = {}
    for item, content in rows:
        w = words(content)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            grams.setdefault(n, set()).add(tuple(w[i : i + n]))
    clean = set()
    for doc, text in want:
        w = words(text)
        if not any(tuple(w[i : i + n]) in own for n, own in grams.items() for i in range(len(w) - n + 1)):
            clean.add(doc)
    for limit in (10**6, 400):
        monkeypatch.setattr(decontaminate, "PASS_HASHES", limit)
        assert {r["doc_id"] for r in decontaminate.remove_contaminated(docs, bench).collect()} == clean
        judged = decontaminate.contamination(docs, bench).where("NOT contaminated").collect()
        assert len(judged) == len(clean) and {r["doc_id"] for r in judged} == clean


def test_empty_tables(spark):
    docs, _, df, bench = tables(spark)
    assert decontaminate.contamination(df.limit(0), bench).count() == 0
    free = decontaminate.contamination(df, bench.limit(0)).collect()
    assert len(free) == len(docs) and not any(r["contaminated"] for r in free)
