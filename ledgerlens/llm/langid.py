"""Language identification by rank-order profiles of character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import column, frugal, map_texts, slices

#: characters taken at once; a longer text is counted in overlapping blocks
BLOCK = 500_000
PROFILE = 300
SPACE = 32


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For every code point: is it a letter?"""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def merge_counts(grams: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    values, where = np.unique(np.concatenate(grams), return_inverse=True)
    return values, np.bincount(where, np.concatenate(counts), len(values)).astype(np.int64)


def block_grams(codes: np.ndarray) -> np.ndarray:
    """Packed 1-, 2- and 3-grams inside padded words; 21 bits per character."""
    c = codes.astype(np.int64)
    one = c[c != SPACE]
    two = (c[:-1] << 21) | c[1:]
    inner = c[1:-1] != SPACE
    three = ((c[:-2] << 42) | (c[1:-1] << 21) | c[2:])[inner]
    return np.concatenate([one, two, three])


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """N-grams of a text with their counts; none if it has no letter.

    Case is folded, everything but letters separates words, and every word is padded
    with a space on both sides. Blocks of a long text overlap by two characters, and a
    block leaves out the n-grams that the next one counts.
    """
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    codes = np.where(letters()[codes], codes, np.uint32(SPACE))
    codes = np.concatenate([[np.uint32(SPACE)], codes, [np.uint32(SPACE)]])
    codes = codes[np.r_[True, (codes[1:] != SPACE) | (codes[:-1] != SPACE)]]
    if len(codes) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(codes) <= BLOCK:
        return np.unique(block_grams(codes), return_counts=True)
    grams, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for start in range(0, len(codes), BLOCK):
        part = codes[start : start + BLOCK + 2]
        new = [np.unique(block_grams(part), return_counts=True)]
        if start + BLOCK < len(codes):  # the overlap is counted by the next block
            again = np.unique(block_grams(codes[start + BLOCK : start + BLOCK + 2]), return_counts=True)
            new.append((again[0], -again[1]))
        grams, counts = merge_counts(
            [grams, *(g for g, _ in new)], [counts, *(n for _, n in new)]
        )
    return grams[counts > 0], counts[counts > 0]


def top(grams: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """Most frequent n-grams, ties to the smaller one."""
    return grams[np.lexsort((grams, -counts))[:size]]


@dataclass(frozen=True)
class Profiles:
    """Most frequent n-grams of every language, as one table of ranks."""

    languages: list[str]
    grams: np.ndarray  # sorted
    ranks: np.ndarray  # n-grams × languages; ``size`` where a profile lacks the n-gram
    size: int

    @staticmethod
    def of(ranked: dict[str, list[int]], size: int) -> Profiles:
        languages = sorted(ranked)
        grams = np.unique(np.array([g for v in ranked.values() for g in v], dtype=np.int64))
        ranks = np.full((len(grams) + 1, len(languages)), size, dtype=np.int32)
        for k, language in enumerate(languages):
            found = np.array(ranked[language], dtype=np.int64)
            ranks[np.searchsorted(grams, found), k] = np.arange(len(found))
        return Profiles(languages, grams, ranks, size)

    def predict(self, text: str | None) -> tuple[str, float]:
        """Nearest profile by out-of-place distance, and 1 − distance / largest distance.

        The distance adds, over the text's most frequent n-grams, how far each is out of
        place in the profile; an n-gram that the profile lacks counts the profile's size.
        """
        grams, counts = gram_counts(text or "")
        if not len(grams) or not self.languages:
            return "und", 0.0
        own = top(grams, counts, self.size)
        at = np.searchsorted(self.grams, own)
        at[at == len(self.grams)] = 0
        at = np.where(self.grams[at] == own, at, len(self.grams))
        ranks = self.ranks[at]
        places = np.arange(len(own))[:, None]
        apart = np.where(ranks == self.size, self.size, np.abs(ranks - places)).sum(axis=0)
        best = int(np.argmin(apart))
        return self.languages[best], float(1 - apart[best] / (self.size * len(own)))


def count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(language, text) → (language, n-gram, count), added up within a run of texts."""
    for batch in batches:
        languages = batch.column("_lang").to_pylist()
        for start, texts in slices(batch.column("_text")):
            found: dict[str, list[str]] = {}
            for language, text in zip(languages[start:], texts):
                found.setdefault(language, []).append(text)
            for language, own in found.items():
                grams, counts = gram_counts("\n".join(own))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([language] * len(grams), pa.string()), pa.array(grams), pa.array(counts)],
                    names=["lang", "gram", "n"],
                )


def learn(
    docs: DataFrame, lang: str = "lang", text: str = "text", size: int = PROFILE,
    max_languages: int = 1000,
) -> Profiles:
    """Profiles of all labelled rows of ``docs``; rows without label or text teach nothing.

    N-grams are added up over all texts. The choice of the most frequent ones works in
    two steps, so that no task gets all n-grams of a frequent language. The driver gets
    ``size`` n-grams per language; more than ``max_languages`` labels are an error.
    """
    seen = docs.select(column(lang).alias("_lang"), column(text).alias("_text"))
    seen = seen.where("_lang IS NOT NULL AND _text IS NOT NULL")
    counted = seen.mapInArrow(frugal(count_batches), "lang string, gram long, n long")
    counted = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = [F.desc("n"), F.asc("gram")]
    salted = W.partitionBy("lang", F.pmod(F.xxhash64("gram"), F.lit(64))).orderBy(*order)
    whole = W.partitionBy("lang").orderBy(*order)
    some = counted.withColumn("k", F.row_number().over(salted)).where(F.col("k") <= size)
    best = some.withColumn("k", F.row_number().over(whole)).where(F.col("k") <= size)
    ranked: dict[str, list[tuple[int, int]]] = {}
    limit = size * max_languages + 1
    rows = best.select("lang", "gram", "k").limit(limit).collect()
    if len(rows) == limit:
        raise ValueError(f"more than {max_languages} languages")
    for r in rows:
        ranked.setdefault(r["lang"], []).append((r["k"], r["gram"]))
    return Profiles.of({k: [g for _, g in sorted(v)] for k, v in ranked.items()}, size)


def identify(docs: DataFrame, profiles: Profiles, keep: dict[str, str], text: str = "text") -> DataFrame:
    """Per row: kept columns, lang_pred and score (0 to 1).

    Null texts and texts without a letter are ``und`` with score 0. Rows are
    independent: repeated rows stay repeated, an empty table gives an empty table.
    """

    def run(texts):
        made = [profiles.predict(t) for t in texts]
        return [m[0] for m in made], [m[1] for m in made]

    return map_texts(docs, keep, text, run, "lang_pred string, score double")
