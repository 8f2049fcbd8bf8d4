"""Prefix tables of byte-pair encodings.

Every prefix of a text has one last token: the token of the vocabulary that ends there
and that merging would leave next to the last token of the prefix before it. An
automaton over the vocabulary finds the tokens ending at each position; a pair test
(does merging both tokens' symbols give just these two tokens?) picks the right one. A
token's own merges are worked out once; a pair test steps through those of its two tokens.
The table of last tokens answers three questions in one pass over a text: the tokens
(followed backwards), their number, and the number of tokens of every prefix.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Hashable
from itertools import islice

import ahocorasick

#: bytes that the words of a task, and its known pairs, may take
MEMORY_BYTES, PAIRS_BYTES = 100_000_000, 40_000_000
#: what an entry of a dictionary takes beside its key and value; a pair test as a whole
ENTRY_BYTES, PAIR_BYTES = 100, 160


class PrefixTable:
    """Last token and token count of every prefix of a text.

    ``tokens``: text of each token → id; every symbol that a text may hold is a token.
    ``merge``: two neighbouring token ids → (rank, merged id), or None.

    The row of a token maps the tokens tested behind it to their own rows, or to False if
    merging does not leave the two; under -1 it has the token itself. So the row of a
    prefix says its last token, and a known pair costs one look-up. The automaton holds
    the longer tokens only: where none of them fits, the last token is the last symbol.
    """

    def __init__(self, tokens: dict[str, int], merge: Callable[[int, int], tuple[int, int] | None]):
        self.texts = {i: t for t, i in tokens.items()}
        self.tokens = tokens
        self.merge = merge
        self.rows: dict[int, dict] = {}  # -1: start of the text
        self.known = 0
        self.steps: dict[int, tuple] = {}
        self.symbols = {text: self.row(i) for text, i in tokens.items() if len(text) == 1}
        self.automaton = ahocorasick.Automaton()
        for text, i in tokens.items():
            if len(text) > 1:
                self.automaton.add_word(text, (i, len(text) - 1))
        self.automaton.make_automaton()

    def row(self, token: int) -> dict:
        found = self.rows.get(token)
        if found is None:
            found = self.rows[token] = {-1: token}
        return found

    def merged(self, text: str, steps: list | None = None) -> list[int]:
        """Tokens by plain merging: best rank first, leftmost among equals.

        ``steps`` gets of every merge its rank and the tokens that are then first and last.
        """
        ids = [self.tokens[c] for c in text]
        merge = self.merge
        pairs = list(map(merge, ids, ids[1:]))
        while True:
            best = min(filter(None, pairs), default=None)
            if best is None:
                return ids
            k = next(k for k, found in enumerate(pairs) if found and found[0] == best[0])
            ids[k : k + 2] = [pairs[k][1]]
            del pairs[k]
            if k:
                pairs[k - 1] = merge(ids[k - 1], ids[k])
            if k < len(pairs):
                pairs[k] = merge(ids[k], ids[k + 1])
            if steps is not None:
                steps += best[0], ids[0], ids[-1]

    def history(self, token: int) -> tuple[tuple | None, int, int]:
        """Steps that merge a token (None: they do not), its first and its last symbol."""
        found = self.steps.get(token)
        if found is None:
            text, steps = self.texts[token], []
            whole = self.merged(text, steps) == [token]
            found = tuple(steps) if whole else None, self.tokens[text[0]], self.tokens[text[-1]]
            self.steps[token] = found
        return found

    def apart(self, left: int, right: int) -> bool:
        """Do the symbols of two tokens, side by side, merge into just these two?

        Until a merge crosses the border, each side takes its own steps, of both next ones
        the better first; so only the pair at the border needs a look at every step.
        """
        ours, _, a = self.history(left)
        theirs, b, _ = self.history(right)
        if ours is None or theirs is None:
            return False
        merge, i, j, m, n = self.merge, 0, 0, len(ours), len(theirs)
        across = merge(a, b)
        while i < m or j < n:
            if j == n or (i < m and ours[i] <= theirs[j]):
                if across and across[0] < ours[i]:
                    return False
                last = ours[i + 2]
                i += 3
                if last != a:
                    a = last
                    across = merge(a, b)
            else:
                if across and across[0] <= theirs[j]:
                    return False
                first = theirs[j + 1]
                j += 3
                if first != b:
                    b = first
                    across = merge(a, b)
        return across is None

    def compatible(self, left: int, right: int) -> dict | bool:
        """Row of the right token if merging leaves these two (at the start: reaches it)."""
        if self.known * PAIR_BYTES >= PAIRS_BYTES:
            for token, row in self.rows.items():
                row.clear()
                row[-1] = token
            self.known = 0
        fits = self.history(right)[0] is not None if left < 0 else self.apart(left, right)
        found = self.rows[left][right] = self.row(right) if fits else False
        self.known += 1
        return found

    def last(self, text: str) -> list[dict]:
        """Rows of the last tokens of the prefixes of length 0, 1, … len(text)."""
        rows, symbols, done = [self.row(-1)], self.symbols, 0
        add = rows.append
        for at, (token, back) in self.automaton.iter(text):
            if at < done:
                continue
            while done < at:
                add(symbols[text[done]])
                done += 1
            found = rows[at - back].get(token)
            if found is None:
                found = self.compatible(rows[at - back][-1], token)
            if found:
                add(found)
                done += 1
        rows += [symbols[symbol] for symbol in text[done:]]
        return rows

    def counts(self, text: str) -> list[int]:
        """Token counts of the prefixes of length 0, 1, … len(text)."""
        count, texts = [0], self.texts
        for end, row in enumerate(islice(self.last(text), 1, None), 1):
            count.append(count[end - len(texts[row[-1]])] + 1)
        return count

    def encode(self, text: str) -> list[int]:
        """Token ids, read backwards from the last token of the whole text."""
        rows, texts = self.last(text), self.texts
        ids, end = [], len(text)
        while end:
            token = rows[end][-1]
            ids.append(token)
            end -= len(texts[token])
        return ids[::-1]


class Memory(dict):
    """What has been worked out per word, in two generations of bounded bytes.

    When the young one is full it becomes the old one, which goes; words that occur
    again move over from the old one, so frequent words stay.
    """

    def __init__(self, make: Callable[[Hashable], object], size: int = MEMORY_BYTES):
        super().__init__()
        self.make, self.size, self.held, self.old = make, size // 2, 0, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self.held += sys.getsizeof(key) + sys.getsizeof(value) + ENTRY_BYTES
        if self.held > self.size:
            self.old, self.held = dict(self), 0
            self.clear()
        self[key] = value
        return value
