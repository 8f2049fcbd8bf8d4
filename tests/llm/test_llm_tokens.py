"""Prefix tables against the libraries whose files they read."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
import tokenizers

from ledgerlens.llm import bpe, pieces, tokencount

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
SIGNS = " \n\t▁éäßñ漢字😀aabbcdeThe'slldve0123.,-  \x1c\x85　ſİ"


def texts():
    draw = random.Random(3)
    made = ["".join(draw.choice(SIGNS) for _ in range(draw.randrange(60))) for _ in range(400)]
    fixed = ["", " ", "  x", "<|endoftext|>a <|endoftext|>", "<s></s><0x0A>", "\x00", "a" * 3000, "the " * 5000]
    return made + fixed


def frame(spark):
    rows = [(i, t, "clash") for i, t in enumerate(texts())]
    rows += [(900, None, None), (901, "same text", "x"), (901, "same text", "x"), (None, "no id", "x")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")


def test_pieces_equal_the_library(spark):
    rows, df = frame(spark)
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = []
    for i, text, _ in rows:
        ids = model.encode(text or "", add_eos=True)
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), model.decode(ids))]
        want.append((i, len(ids), *sha))
    found = pieces.encode_digests(df, PIECES, {"doc_id": "doc_id"})
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)
    back = pieces.encode(df.where("doc_id = 901"), PIECES, {"doc_id": "doc_id"}).collect()
    assert [r["decoded"] for r in back] == ["same text"] * 2 and back[0]["ids"][-1] == 2
    assert pieces.encode(df.limit(0), PIECES, {"doc_id": "doc_id"}).count() == 0


def test_counts_equal_the_library(spark):
    rows, df = frame(spark)
    library = tokenizers.Tokenizer.from_file(BYTES)

    def number(text):
        return len(library.encode(text, add_special_tokens=False).ids)

    want = [(i, len((t or "").encode()), number(t or "")) for i, t, _ in rows]
    found = tokencount.token_counts(df, BYTES, 30, {"doc_id": "doc_id"}).collect()
    assert sorted([tuple(r)[:3] for r in found], key=repr) == sorted(want, key=repr)
    for r in found:
        assert r["over_limit"] == (r["n_tokens"] > 30)
        assert (r["fit_bytes"] < r["n_bytes"]) == r["over_limit"]
    assert tokencount.token_counts(df.limit(0), BYTES, 30, {"doc_id": "doc_id"}).count() == 0


@pytest.mark.parametrize("text", [t[:120] for t in texts()[::9]])
def test_every_prefix_has_its_exact_count(text):
    library = tokenizers.Tokenizer.from_file(BYTES)
    prefixes = tokencount.Prefixes(tokencount.load(BYTES), text)
    want = [len(library.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]
    special = "<|endoftext|>"
    inside = {i for i in range(len(text)) if special in text and text.find(special, max(0, i - 12)) < i}
    assert all(prefixes.at(i) == want[i] for i in range(len(text) + 1) if i not in inside)
    for limit in (0, 3, 10):
        if not inside:
            assert prefixes.fit(limit) == max(i for i, n in enumerate(want) if n <= limit)


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        tokencount.TokenCounter(public_tokenizers.path("word_bpe_49k.json"))


def small_table(seed):
    """A made vocabulary over two symbols, ranks in any order, with its plain merging."""
    draw = random.Random(seed)
    tokens, ranks = {"a": 0, "b": 1}, {}
    for _ in range(12):
        left, right = draw.choice(list(tokens)), draw.choice(list(tokens))
        merged = tokens.setdefault(left + right, len(tokens))
        ranks[(tokens[left], tokens[right])] = (draw.randrange(8), merged)
    return bpe.PrefixTable(tokens, lambda a, b: ranks.get((a, b)))


@pytest.mark.parametrize("seed", range(60))
def test_pair_tests_equal_plain_merging(seed):
    table = small_table(seed)
    for left, a in table.tokens.items():
        for right, b in table.tokens.items():
            assert table.apart(a, b) == (table.merged(left + right) == [a, b])


def test_a_pair_test_looks_only_at_the_border():
    """Merging both tokens anew took 66 looks a pair here."""
    model = pieces.Pieces(PIECES)
    table, looks = model.prefixes, []
    plain = table.merge
    table.merge = lambda a, b: looks.append(1) or plain(a, b)
    long = [t for t in table.tokens if len(t) == 8 and t.isascii()][:60]
    for left in long:
        for right in long:
            table.encode(left + right)
    assert table.known > 3000 and len(looks) < 10 * table.known
    assert table.encode(long[0] + long[1]) == table.merged(long[0] + long[1])


def test_a_text_over_the_limit_is_split_once():
    counter, calls = tokencount.load(BYTES), []
    plain = counter.split
    counter.split = lambda text: calls.append(len(text)) or plain(text)
    try:
        text = "one two, three  four\n" * 500
        columns = tokencount.counts(BYTES, 100)([text])
    finally:
        counter.split = plain
    assert columns[2] == [True] and columns[3][0] < len(text)
    assert calls.count(len(text)) == 1
