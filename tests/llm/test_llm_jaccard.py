import random

import numpy as np
import pytest

from ledgerlens.llm import jaccard


def brute(rows, size=4, percent=85):
    sets, parent = {}, {}
    for i, text in rows:
        if i is None:
            continue
        words = (text or "").encode().lower().split()
        n = min(size, len(words))
        own = frozenset(tuple(words[k : k + n]) for k in range(len(words) - n + 1)) if n else frozenset()
        sets.setdefault(i, set()).add(own)
        parent[i] = i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    flat = [(i, s) for i, own in sets.items() for s in own if s]
    for k, (i, a) in enumerate(flat):
        for j, b in flat[:k]:
            if 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def corpus():
    draw = random.Random(6)
    words = [f"w{k}" for k in range(400)]
    passage = " ".join(draw.choice(words) for _ in range(60))
    rows = []
    for base in range(25):
        text = [draw.choice(words) for _ in range(draw.choice([3, 6, 12, 40, 150, 400]))]
        for _ in range(draw.choice([1, 2, 6])):
            own = list(text)
            for _ in range(draw.randrange(0, 4)):
                own[draw.randrange(len(own))] = draw.choice(words)
            rows.append((len(rows), " ".join(own) + (f" {passage}" if base % 3 == 0 else "")))
    near = [draw.choice(words) for _ in range(150)]
    for _ in range(150):  # one large group of near copies, linked in part
        own = list(near)
        for _ in range(draw.randrange(0, 7)):
            own[draw.randrange(150)] = draw.choice(words)
        rows.append((len(rows), " ".join(own)))
    rows += [(len(rows) + k, "same  Words\nhere and there again") for k in range(40)]
    rows += [(900, None), (901, ""), (902, "one"), (903, "ONE"), (904, "two words"), (905, " \t\n")]
    rows += [(906, "x " * 30000), (907, "X " * 29999), (5, rows[5][1]), (None, rows[5][1])]
    return rows


@pytest.mark.parametrize("tile, most", [(64, 4096), (1, 10)])
def test_components_equal_brute_force(spark, monkeypatch, tile, most):
    monkeypatch.setattr(jaccard, "TILE", tile)
    monkeypatch.setattr(jaccard, "TILE_MOST", most)  # many blocks, many bands
    rows = corpus()
    want = brute(rows)
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, component_id string")
    found = jaccard.similar_groups(df).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r["component_id"] == (None if r["doc_id"] is None else want[r["doc_id"]])
    kept = jaccard.keep_one(df.drop("component_id"))
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(x for x in ids if x is not None) == sorted({want[i] for i in want})
    assert ids.count(None) == 1


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.similar_groups(df).count() == 0 and jaccard.keep_one(df).count() == 0


@pytest.mark.parametrize("small", [4, 7, 11, 30, 170, 900])
def test_linked_sets_share_a_key(small):
    """The worst pairs that still link: as many differences as the threshold allows."""
    bands, random_ = jaccard.Bands(85), np.random.default_rng(small)
    for large in sorted({small, small + 1, small * 100 // 85}):
        overlap = -(-85 * (small + large) // 185)
        if overlap > small:
            continue
        for _ in range(30):
            pool = random_.integers(0, 2**63, small + large, dtype=np.uint64)
            a = np.unique(pool[:small])
            b = np.unique(np.concatenate([pool[:overlap], pool[small : small + large - overlap]]))
            if small == large == overlap:
                continue
            keys = [set(np.concatenate(bands.keys(x) or [np.zeros(0, np.uint64)]).tolist()) for x in (a, b)]
            assert keys[0] & keys[1]


@pytest.mark.parametrize("size", [8, 30, 170, 900])
def test_linked_sets_share_several_keys(size):
    """In any common order, with the fewest elements that linked sets share."""
    bands, random_ = jaccard.Bands(85), np.random.default_rng(size)
    for large in (size, size * 100 // 85):
        overlap = bands.overlap(size, large)
        for _ in range(30):
            pool = random_.permutation(np.arange(size + large, dtype=np.uint64) + np.uint64(1))
            a, b = pool[:size], np.concatenate([pool[:overlap], pool[size : size + large - overlap]])
            keys = [set(np.concatenate(bands.keys(np.sort(x))).tolist()) for x in (a, b)]
            assert len(keys[0] & keys[1]) >= jaccard.SHARED


def test_a_common_passage_makes_no_candidates(spark, monkeypatch):
    draw = random.Random(9)
    words = [f"w{k}" for k in range(3000)]
    passage = " ".join(draw.choice(words) for _ in range(60))
    texts = [" ".join(draw.choice(words) for _ in range(100)) for _ in range(200)]
    rows = [(k, f"{t} {passage}") for k, t in enumerate(texts)]
    rows += [(200 + k, f"{texts[k]} {passage} end") for k in range(6)]
    seen, tiles_of = [], jaccard.tiles_of

    def tiles(members, percent):
        seen.append(members.count())
        return tiles_of(members, percent)

    monkeypatch.setattr(jaccard, "tiles_of", tiles)
    found = jaccard.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == {k: k % 200 for k, _ in rows}
    assert seen == [12]
