"""License scan: fingerprints and key words of templates, then banded alignment."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import column, mix, slices

#: Public license notices (license, text).
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("proprietary", "All rights reserved"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("AGPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
]

GRAM, WINDOW = 3, 4
#: words of templates that one pass holds in every task; more templates take more passes
PASS_WORDS = 500_000
WORD = re.compile(r"\w+")


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Places of the smallest hash of every window, the last one among equals.

    A sequence shorter than the window keeps its smallest.
    """
    if len(hashes) <= window:
        return np.array([len(hashes) - 1 - int(np.argmin(hashes[::-1]))]) if len(hashes) else np.zeros(0, int)
    views = np.lib.stride_tricks.sliding_window_view(hashes, window)
    return np.unique(np.arange(len(views)) + window - 1 - np.argmin(views[:, ::-1], axis=1))


class Templates:
    """Inverted index from fingerprints and key words to the places of templates.

    A match leaves at most ``n - need`` of the template's ``n`` words out, so it holds one
    of any ``n - need + 1`` of them: its key words, those in the fewest templates.
    """

    def __init__(self, rows: list[tuple[int, str, str]], threshold: float):
        self.threshold = threshold
        self.ids = [(template, license_) for template, license_, _ in rows]
        words = [WORD.findall(text.lower()) for _, _, text in rows]
        self.known = {w: k for k, w in enumerate(sorted({w for ws in words for w in ws}))}
        self.base = len(self.known) + 1
        self.sequences = [np.array([self.known[w] for w in ws], np.int64) for ws in words]
        self.index: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k, sequence in enumerate(self.sequences):
            codes = self.codes(sequence)
            for place in winnow(mix(codes.astype(np.uint64)), WINDOW):
                self.index[int(codes[place])].append((k, int(place)))
        self.prints = np.array(sorted(self.index), np.int64)
        self.need = [max(1, math.ceil(threshold * len(s) - 1e-9)) for s in self.sequences]
        spread = Counter(w for ws in words for w in set(ws))
        self.keys: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k, ws in enumerate(words):
            rarest = sorted(range(len(ws)), key=lambda i: (spread[ws[i]], -len(ws[i]), i))
            for place in rarest[: max(1, len(ws) - self.need[k] + 1)]:
                self.keys[self.known[ws[place]]].append((k, place))
        self.is_key = np.zeros(self.base, bool)  # the last place is that of unknown words
        self.is_key[list(self.keys)] = True

    def codes(self, ids: np.ndarray) -> np.ndarray:
        """A number for every run of ``GRAM`` words; −1 where a word is in no template."""
        number = len(ids) - GRAM + 1
        if number <= 0:
            return np.zeros(0, np.int64)
        out, good = np.zeros(number, np.int64), np.ones(number, bool)
        for k in range(GRAM):
            part = ids[k : k + number]
            good &= part >= 0
            out = out * self.base + part
        return np.where(good, out, -1)

    def scan(self, text: str) -> list[tuple]:
        """(template, license, start, end, matched, words, coverage) of what is found.

        Places are code points. Every start that a hit of a template points to is aligned
        by itself, within a band around it, if enough of the words there are in the template.
        """
        words = WORD.findall(text.lower())
        ids = np.fromiter((self.known.get(w, -1) for w in words), np.int64, len(words))
        by_template: dict[int, set[int]] = defaultdict(set)
        codes = self.codes(ids)
        if len(self.prints) and len(codes):
            at = np.searchsorted(self.prints, codes)
            for place in np.flatnonzero(self.prints[np.minimum(at, len(self.prints) - 1)] == codes):
                for template, offset in self.index[int(codes[place])]:
                    by_template[template].add(int(place) - offset)
        for place in np.flatnonzero(self.is_key[ids]):
            for template, offset in self.keys[int(ids[place])]:
                by_template[template].add(int(place) - offset)
        found, spans = [], None
        for template, starts in sorted(by_template.items()):
            sequence, need = self.sequences[template], self.need[template]
            # below the least match, so that a band around one holds no other whole one
            band = min(max(3, len(sequence) // 10), need - 1)
            begins = np.array(sorted(starts))
            inside = np.append(0, np.cumsum(np.isin(ids, sequence)))
            low, high = (np.clip(begins + x, 0, len(ids)) for x in (-band, len(sequence) + band))
            own = set()
            for begin in begins[inside[high] - inside[low] >= need].tolist():
                matched, first, last = align(sequence, ids, begin - band, begin + band)
                if matched >= need:
                    own.add((first, last, matched))
            if own and spans is None:
                lowered = [m.span() for m in WORD.finditer(text.lower())]
                spans = lowered if len(text.lower()) == len(text) else original_spans(text)
            for first, last, matched in sorted(own):
                coverage = matched / len(sequence)
                found.append((*self.ids[template], spans[first][0], spans[last][1], matched, len(sequence), coverage))
        return best_of(found)


def best_of(found: list[tuple]) -> list[tuple]:
    """Of matches that overlap, the one with most equal words, in text order.

    Ties go to the higher coverage, then to the smaller template id.
    """
    kept: list[tuple] = []  # by start
    for match in sorted(found, key=lambda m: (-m[4], -m[6], m[0], m[2])):
        at = bisect_left(kept, match[2], key=lambda m: m[2])
        free_before = at == 0 or kept[at - 1][3] <= match[2]
        if free_before and (at == len(kept) or match[3] <= kept[at][2]):
            kept.insert(at, match)
    return kept


def original_spans(text: str) -> list[tuple[int, int]]:
    """Spans of the words of the lower-cased text in a text that lower-casing lengthens."""
    places = [k for k, c in enumerate(text) for _ in c.lower()] + [len(text)]
    lowered = "".join(c.lower() for c in text)
    return [(places[m.start()], places[m.end() - 1] + 1) for m in WORD.finditer(lowered)]


def align(template: np.ndarray, words: np.ndarray, low: int, high: int) -> tuple[int, int, int]:
    """Best local alignment with the template's start between ``low`` and ``high``.

    Match 2, mismatch and gap −1; returns the number of equal words and the first and
    last of them in ``words``. Only the band of diagonals low … high is filled. Ties
    prefer the diagonal, then fewer document words.
    """
    width = high - low + 1
    empty = (0, 0, -1, -1)  # score, matched, first, last
    row, best = [empty] * (width + 1), empty
    for i, word in enumerate(template):
        new = [empty] * (width + 1)
        for d in range(width):
            j = low + d + i
            if not 0 <= j < len(words):
                continue
            score, matched, first, last = row[d]  # the diagonal keeps its place in the band
            if words[j] == word:
                cell = (score + 2, matched + 1, first if first >= 0 else j, j)
            else:
                cell = (score - 1, matched, first, last)
            for other in (row[d + 1], new[d - 1] if d else empty):
                if other[0] - 1 > cell[0]:
                    cell = (other[0] - 1, *other[1:])
            if cell[0] <= 0:
                cell = empty
            new[d] = cell
            if cell[:2] > best[:2]:
                best = cell
        row = new
    return best[1], best[2], best[3]


FOUND = [
    ("template_id", "int"), ("license", "string"), ("start", "int"), ("end", "int"),
    ("matched", "int"), ("words", "int"), ("coverage", "double"),
]


def scan_batches(templates: Templates, arrow: pa.Schema):
    """Adds the matches of one pass to ``_found``, of overlapping ones the best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [n for n, _ in FOUND]
        for batch in batches:
            for start, texts in slices(batch.column("_text")):
                part = batch.slice(start, len(texts))
                found = []
                for text, before in zip(texts, part.column("_found").to_pylist()):
                    own = templates.scan(text) if text else []
                    if before:
                        own = best_of(own + [tuple(m[n] for n in names) for m in before])
                    found.append([dict(zip(names, m)) for m in own])
                arrays = [part.column(f.name).cast(f.type) for f in arrow if f.name != "_found"]
                arrays.append(pa.array(found, arrow.field("_found").type))
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return run


def license_matches(
    docs: DataFrame, templates: DataFrame, keep: dict[str, str], text: str = "text", threshold: float = 0.8
) -> DataFrame:
    """A row per match: kept columns, template_id, license, start, end, matched, words, coverage.

    ``templates`` has template_id, license and text. ``coverage`` is the share of the
    template's words that the best alignment finds in the text, at least ``threshold``;
    of overlapping matches the one with most equal words counts;
    start and end are code points, the end exclusive. Any match that reaches ``threshold``
    is a candidate; its alignment may drift by a tenth of the template's words, at least
    three. Templates with a null or without words
    match nothing. Null, empty and unmatched texts have no row; repeated rows have
    their rows each; an empty table gives an empty table.
    """
    known = templates.where("template_id IS NOT NULL AND license IS NOT NULL AND text IS NOT NULL")
    sized = known.select("template_id", "license", "text", F.char_length("text").alias("n"))
    passes = (sized.agg(F.sum("n")).first()[0] or 0) // (4 * PASS_WORDS) + 1
    kind = "array<struct<" + ",".join(f"`{n}`:{t}" for n, t in FOUND) + ">>"
    found = docs.select(
        *(column(c).alias(n) for n, c in keep.items()), column(text).alias("_text"),
        F.array().cast(kind).alias("_found"),
    )
    indexes = []
    for part in range(passes):
        own = sized.where(F.pmod(F.xxhash64("template_id"), F.lit(passes)) == part).drop("n").orderBy("template_id")
        rows = [tuple(r) for r in own.collect()]
        rows = [r for r in rows if WORD.search(r[2])]
        if rows:
            indexes.append(Templates(rows, threshold))
    for k, index in enumerate(indexes, 1):  # the last pass has no more use for the texts
        out = (found if k < len(indexes) else found.drop("_text")).schema
        found = found.mapInArrow(scan_batches(index, to_arrow_schema(out)), out)
    return found.select(*keep, F.inline("_found"))
