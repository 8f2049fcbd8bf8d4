import os
from collections import Counter

import pytest

from ledgerlens.llm import langid
from ledgerlens.llm.queries import LLM_QUERIES

FOLDER = "/root/testdata/sf0.01"


def grams(text):
    clean = "".join(c if c.isalpha() else " " for c in text.lower())
    found = Counter()
    for word in clean.split():
        padded = f" {word} "
        for n in (1, 2, 3):
            found.update(padded[i : i + n] for i in range(len(padded) - n + 1))
    found.pop(" ", None)
    return found


def packed(gram):
    code = 0
    for c in gram:
        code = code << 21 | ord(c)
    return code


@pytest.mark.parametrize("block", [500_000, 7])
def test_counts_equal_brute_force(monkeypatch, block):
    monkeypatch.setattr(langid, "BLOCK", block)
    for text in ("", "12 !?", "Ab ab, É!", "über-Maß 漢字 a1b", "the cat  sat " * 9, "x", "  lead and trail  "):
        own = dict(zip(*(x.tolist() for x in langid.gram_counts(text))))
        assert own == {packed(g): n for g, n in grams(text).items()}


def test_prediction_equals_the_definition():
    texts = {"a": "the cat and the hat sat", "b": "der hund und die katze", "c": "le chat et le chien"}
    size = 40

    def ranked(text):
        return sorted(grams(text), key=lambda g: (-grams(text)[g], packed(g)))[:size]

    profiles = langid.Profiles.of({k: [packed(g) for g in ranked(t)] for k, t in texts.items()}, size)
    for text in ("the hat", "und der hut", "le chien", "zzz", "a"):
        own, best = ranked(text), {}
        for k, t in texts.items():
            ranks = {g: i for i, g in enumerate(ranked(t))}
            best[k] = sum(abs(ranks[g] - i) if g in ranks else size for i, g in enumerate(own))
        want = min(best, key=lambda k: (best[k], k))
        assert profiles.predict(text) == (want, pytest.approx(1 - best[want] / (size * len(own))))
    assert profiles.predict(None) == profiles.predict("12") == ("und", 0.0)


def test_rows_and_cases(spark):
    rows = [(1, "the cat", "en", "x"), (2, "der hund", "de", "x"), (3, None, "en", "x"), (4, "no label", None, "x"),
            (5, "", "en", "x"), (1, "the cat", "en", "x"), (None, "the " * 300_000, "en", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    profiles = langid.learn(df)
    assert profiles.languages == ["de", "en"]
    found = langid.identify(df, profiles, {"doc_id": "doc_id"}).collect()
    assert len(found) == len(rows)
    assert Counter((r["doc_id"], r["lang_pred"]) for r in found) == Counter(
        [(1, "en"), (1, "en"), (2, "de"), (3, "und"), (5, "und"), (None, "en"),
         (4, next(r["lang_pred"] for r in found if r["doc_id"] == 4))])
    empty = langid.learn(df.limit(0))
    assert {r["lang_pred"] for r in langid.identify(df, empty, {"doc_id": "doc_id"}).collect()} == {"und"}
    with pytest.raises(ValueError):
        langid.learn(df, max_languages=0)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables missing")
def test_held_out_accuracy(spark):
    found = LLM_QUERIES["op6_language_id"](spark, FOLDER)
    labels = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang")
    rows = found.join(labels, "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.95 * len(rows)
