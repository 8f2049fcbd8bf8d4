"""Exact token counts of whole texts and of their prefixes (byte-level BPE)."""

from __future__ import annotations

import json
from bisect import bisect_right
from functools import lru_cache
from itertools import accumulate

import regex
from pyspark.sql import DataFrame

from .bpe import Memory, PrefixTable
from .common import map_texts

#: Fixed value: how byte-level vocabularies split a text before merging.
SPLIT = r" ?\p{L}+| ?\p{N}+|'(?:s|t|re|ve|m|ll|d)| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLANK = regex.compile(r"\s+").fullmatch


def byte_letters() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes in byte-level vocabularies → byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    letters = {chr(b): b for b in shown}
    return letters | {chr(256 + k): b for k, b in enumerate(hidden)}


class Prefixes:
    """Token counts of all prefixes of one text.

    ``ends`` are the ends of the pre-tokens, ``totals`` the exact number of tokens up
    to each. A prefix that ends inside a pre-token is answered from the prefix table of
    what is cut off, which is as short as that pre-token.
    """

    def __init__(self, counter: TokenCounter, text: str, parts: tuple[list, list] | None = None):
        self.counter, self.text = counter, text
        words, numbers = parts or counter.parts(text)
        self.ends = list(accumulate(map(len, words), initial=0))
        self.totals = list(accumulate(numbers, initial=0))

    def run_start(self, k: int) -> int:
        """Last pre-token end at or before ``ends[k]`` that no white space precedes.

        A run of white space is split differently once a word follows it, so a prefix
        that ends in one is counted from the start of the run.
        """
        while k and BLANK(self.text[self.ends[k - 1] : self.ends[k]]):
            k -= 1
        return k

    def at(self, length: int) -> int:
        """Exact number of tokens of ``text[:length]``."""
        k = self.run_start(bisect_right(self.ends, length) - 1)
        tail = self.text[self.ends[k] : length]
        return self.totals[k] + sum(self.counter.words[w] for w in self.counter.split(tail))

    def inside(self, k: int) -> list[tuple[int, int]]:
        """(length, tokens) of all prefixes that end inside or at the end of pre-token k."""
        start, end = self.ends[k], self.ends[k + 1]
        word = self.text[start:end]
        if word == self.counter.special or (word[0] == "'" and word[1:].isalpha()):
            return [(n, self.at(n)) for n in range(start + 1, end + 1)]
        base = self.run_start(k) if BLANK(word) else k
        offset = self.ends[base]
        counts = self.counter.characters(self.text[offset:end])
        return [(n, self.totals[base] + counts[n - offset]) for n in range(start + 1, end + 1)]

    def fit(self, limit: int) -> int:
        """Length of the longest prefix of at most ``limit`` tokens.

        Counts at the ends of pre-tokens grow, but for a run of white space, which may
        need fewer tokens in whole; so the search starts two pre-tokens further on.
        """
        k = min(bisect_right(self.totals, limit) + 1, len(self.ends) - 1)
        for j in range(k - 1, -1, -1):
            for length, tokens in reversed(self.inside(j)):
                if tokens <= limit:
                    return length
        return 0


class TokenCounter:
    """Counts as the tokenizers library gives them for a byte-level BPE file.

    Special tokens inside a text count one each, as is that library's default.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        added = [t["content"] for t in spec["added_tokens"]]
        pre, model = spec["pre_tokenizer"], spec["model"]
        plain = model["type"] == "BPE" and pre["type"] == "ByteLevel" and pre["use_regex"]
        if not plain or pre["add_prefix_space"] or spec["normalizer"] or len(added) > 1:
            raise ValueError(f"{path}: not a plain byte-level BPE file")
        self.special = added[0] if added else None
        letters = byte_letters()
        latin = {shown: chr(b) for shown, b in letters.items()}
        vocabulary = {
            "".join(latin[c] for c in token): i
            for token, i in model["vocab"].items()
            if token not in added
        }
        ids, ranks = model["vocab"], {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            ranks[(ids[left], ids[right])] = (rank, ids[left + right])
        self.prefixes = PrefixTable(vocabulary, lambda a, b: ranks.get((a, b)))
        self.split = regex.compile(SPLIT).findall
        self.words = Memory(self.word)

    def word(self, word: str) -> int:
        """Number of tokens of one pre-token."""
        return len(self.prefixes.encode(word.encode("utf-8").decode("latin-1")))

    def characters(self, word: str) -> list[int]:
        """Tokens of the prefixes of 0, 1, … characters of one pre-token."""
        count = self.prefixes.counts(word.encode("utf-8").decode("latin-1"))
        ends = accumulate((len(c.encode()) for c in word), initial=0)
        return [count[e] for e in ends]

    def parts(self, text: str) -> tuple[list[str], list[int]]:
        """Pre-tokens and special tokens of a text, and the number of tokens of each."""
        if not self.special or self.special not in text:
            words = self.split(text)
            return words, [*map(self.words.__getitem__, words)]
        words, numbers = [], []
        for k, part in enumerate(text.split(self.special)):
            if k:
                words.append(self.special)
                numbers.append(1)
            found = self.split(part)
            words += found
            numbers += map(self.words.__getitem__, found)
        return words, numbers


@lru_cache(maxsize=1)
def load(path: str) -> TokenCounter:
    """The counter of a task; it goes with the task's last text."""
    return TokenCounter(path)


def release() -> None:
    load.cache_clear()


def counts(path: str, limit: int):
    """Texts → columns n_bytes, n_tokens, over_limit, fit_bytes."""

    def run(texts):
        counter = load(path)
        columns = ([], [], [], [])
        for text in texts:
            text = text or ""
            parts = counter.parts(text)
            size, number = len(text.encode()), sum(parts[1])
            over = number > limit
            columns[0].append(size)
            columns[1].append(number)
            columns[2].append(over)
            fit = Prefixes(counter, text, parts).fit(limit) if over else len(text)
            columns[3].append(len(text[:fit].encode()) if over else size)
        return columns

    return run


def token_counts(
    docs: DataFrame, path: str, limit: int, keep: dict[str, str], text: str = "text"
) -> DataFrame:
    """Per row: kept columns, n_bytes, n_tokens, over_limit, and fit_bytes.

    ``fit_bytes`` is the UTF-8 length of the longest prefix of whole characters with at
    most ``limit`` tokens. Null and empty texts have no bytes and no tokens. Rows are independent:
    repeated rows stay repeated, an empty table gives an empty table, and columns that
    are not named are not read.
    """
    schema = "n_bytes long, n_tokens long, over_limit boolean, fit_bytes long"
    return map_texts(docs, keep, text, counts(path, limit), schema, release)
