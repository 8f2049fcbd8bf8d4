"""SentencePiece BPE models: exact ids and decoding with prefix tables."""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

from pyspark.sql import DataFrame

from .bpe import Memory, PrefixTable
from .common import map_texts

SPACE = "▁"
CHUNK = re.compile(" *[^ ]+| +")


class Pieces:
    """Encoder and decoder for a BPE model with byte fallback and plain normalisation.

    A piece never has a space mark behind another character, so merges stay inside
    chunks of "spaces, then other characters": chunks are encoded on their own, and
    equal chunks once per task. Characters outside the vocabulary become byte pieces
    and cut a chunk. Models for which any of this is not so are refused.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.names = [model.id_to_piece(i) for i in range(size)]
        self.bytes = {int(self.names[i][1:-1], 16): i for i in range(size) if model.is_byte(i)}
        self.silent = {i for i in range(size) if model.is_control(i)}
        special = self.silent | set(self.bytes.values())
        special |= {i for i in range(size) if model.is_unknown(i)}
        plain = {self.names[i]: i for i in range(size) if i not in special}
        ranks = [-model.get_score(i) for i in range(size)]
        marks = any(SPACE in name.lstrip(SPACE) for name in plain)
        gaps = any(c not in plain for name in plain for c in name)
        probe = model.decode(model.encode(" a  Äﬁ "))
        if marks or gaps or len(self.bytes) != 256 or probe != " a  Äﬁ ":
            raise ValueError(f"{path}: not a plain BPE model with byte fallback")
        self.end = model.eos_id()
        self.value = {i: b for b, i in self.bytes.items()}
        self.hidden = self.silent | set(self.value)
        names, known = self.names, plain

        def merge(left: int, right: int):
            found = known.get(names[left] + names[right])
            return None if found is None else (ranks[found], found)

        self.prefixes = PrefixTable(plain, merge)
        self.words = Memory(self.word)
        self.changed: dict[str, str] = {}
        self.outside = re.compile("[^" + re.escape("".join(c for c in plain if len(c) == 1)) + "]")

    def ids(self, chunk: str) -> list[int]:
        """Ids of one chunk, in which spaces are spaces."""
        text = chunk.replace(" ", SPACE)
        if not self.outside.search(text):
            return self.prefixes.encode(text)
        ids, start = [], 0
        for found in self.outside.finditer(text):
            ids += self.prefixes.encode(text[start : found.start()])
            ids += [self.bytes[b] for b in found.group().encode()]
            start = found.end()
        return ids + self.prefixes.encode(text[start:])

    def text(self, ids: list[int]) -> str:
        """Text of ids of one chunk; runs of byte pieces are UTF-8."""
        if self.hidden.isdisjoint(ids):
            return "".join([self.names[i] for i in ids]).replace(SPACE, " ")
        out, run = [], bytearray()
        for i in ids:
            if i in self.value:
                run.append(self.value[i])
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run = bytearray()
            if i not in self.silent:
                out.append(self.names[i])
        if run:
            out.append(run.decode("utf-8", "replace"))
        return "".join(out).replace(SPACE, " ")

    def word(self, word: str) -> str:
        """Ids of a chunk without its first space, as decimals.

        The ids are decoded at once; a text that differs from the chunk is kept.
        """
        ids = self.ids(" " + word)
        decoded = self.text(ids)
        if decoded != " " + word:
            self.changed[word] = decoded
        return " ".join(map(str, ids))

    def document(self, text: str | None) -> tuple[int, str, str]:
        """(number of ids, ids as decimals, text decoded from them); end id included."""
        if not text:
            return 1, str(self.end), ""
        text = text.replace(SPACE, " ")
        words = text.split(" ")
        if "" in words:
            words = [c[1:] for c in CHUNK.findall(" " + text)]
        ids = " ".join(map(self.words.__getitem__, words)) + f" {self.end}"
        decoded = text
        if self.changed:
            decoded = "".join([self.changed.get(w, " " + w) for w in words]).removeprefix(" ")
        return ids.count(" ") + 1, ids, decoded


@lru_cache(maxsize=1)
def load(path: str) -> Pieces:
    """The model of a task; it goes with the task's last text."""
    return Pieces(path)


def release() -> None:
    load.cache_clear()


def digests(path: str):
    """Texts → columns n_tokens, ids_sha256, decoded_sha256."""

    def run(texts):
        model = load(path)
        columns = ([], [], [])
        for text in texts:
            number, ids, decoded = model.document(text)
            columns[0].append(number)
            columns[1].append(hashlib.sha256(ids.encode()).hexdigest())
            columns[2].append(hashlib.sha256(decoded.encode()).hexdigest())
        return columns

    return run


def ids_and_text(path: str):
    """Texts → columns n_tokens, ids, decoded."""

    def run(texts):
        model = load(path)
        columns = ([], [], [])
        for text in texts:
            number, ids, decoded = model.document(text)
            columns[0].append(number)
            columns[1].append([int(i) for i in ids.split(" ")])
            columns[2].append(decoded)
        return columns

    return run


def encode_digests(docs: DataFrame, path: str, keep: dict[str, str], text: str = "text") -> DataFrame:
    """Per row: kept columns, n_tokens (end id included), ids_sha256, decoded_sha256.

    Null and empty texts have the end id only and decode to the empty text. Rows are
    independent: repeated rows stay repeated, an empty table gives an empty table, and
    columns that are not named are not read. A text of any length is encoded in whole.
    """
    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_texts(docs, keep, text, digests(path), schema, release)


def encode(docs: DataFrame, path: str, keep: dict[str, str], text: str = "text") -> DataFrame:
    """Per row: kept columns, n_tokens, ids (array, end id last) and the decoded text.

    Cases as in ``encode_digests``.
    """
    schema = "n_tokens long, ids array<int>, decoded string"
    return map_texts(docs, keep, text, ids_and_text(path), schema, release)
