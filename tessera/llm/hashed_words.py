"""Hashes of words and of byte n-grams inside words, for windows of texts at once."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

SPACE = 32
#: Odd multipliers of the polynomial and of the final mixing step.
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    up, down = np.full(n, _BASE, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def mix(h: np.ndarray, bits: int) -> np.ndarray:
    """The top ``bits`` of mixed 64-bit hashes, as indices."""
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return (h >> np.uint64(64 - bits)).astype(np.int64)


class Window:
    """Texts laid end to end, each preceded and followed by a space.

    ``table`` maps every byte before hashing; bytes mapped to a space separate
    words.  ``starts`` and ``ends`` delimit words, ``doc`` names their text.
    """

    def __init__(self, texts: list[bytes], table: np.ndarray):
        self.n = len(texts)
        self.bytes = table[np.frombuffer(b" " + b"".join(t + b" " for t in texts), np.uint8)]
        #: Position after the space that follows each text.
        self.upto = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64) if texts else np.zeros(0, np.int64)
        space = self.bytes == SPACE
        self.space = space
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        self.starts, self.ends = edge[0::2], edge[1::2]
        self.doc = np.searchsorted(self.upto, self.starts, "right")

    def _spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        up, down = _powers(1 << max(16, int(len(self.bytes)).bit_length()))
        total = np.concatenate([[np.uint64(0)], np.cumsum(self.bytes.astype(np.uint64) * up[: len(self.bytes)])])
        return (total[ends] - total[starts]) * down[starts]

    def words(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        return self._spans(self.starts, self.ends) + np.uint64(1)

    def beginnings(self, which: np.ndarray, n: int) -> np.ndarray:
        """A 64-bit hash of the first n bytes of some of the words, all longer than that."""
        return self._spans(self.starts[which], self.starts[which] + n) + np.uint64(2 + n)

    def ngrams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, whether valid) of the n bytes from each position; only the outer two may be a space."""
        a, count = self.bytes.astype(np.uint64), len(self.bytes) - n + 1
        if count <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        h, crossing = np.zeros(count, np.uint64), np.zeros(count, bool)
        for j in range(n):
            h = h * _BASE + a[j : j + count] + np.uint64(1)
            if 0 < j < n - 1:
                crossing |= self.space[j : j + count]
        return h + np.uint64(n), ~crossing

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sums per text of a value for each byte position (the space before a text counts as its own)."""
        total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
        cuts = np.minimum(np.concatenate([[0], self.upto]), len(values))
        return total[cuts[1:]] - total[cuts[:-1]]


def spaced(table: np.ndarray | None = None) -> np.ndarray:
    """A byte table with ASCII white space made plain spaces."""
    table = np.arange(256, dtype=np.uint8) if table is None else table
    table[[9, 10, 11, 12, 13]] = SPACE
    return table


def letters() -> np.ndarray:
    """A byte table that folds A-Z and separates at every other ASCII byte but a-z."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    rest = np.ones(128, bool)
    rest[65:91] = rest[97:123] = False
    table[:128][rest] = SPACE
    return table
