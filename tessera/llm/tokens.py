"""Whitespace tokens of many texts at once, as numpy arrays over their joined bytes."""

from __future__ import annotations

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_PLACE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)


class Tokens:
    """Tokens of the texts whose bytes are ``raw[at[i]:at[i + 1]]``: start and end in raw, and the text of each."""

    def __init__(self, raw: np.ndarray, at: np.ndarray):
        self.raw, self.at = raw, at
        inside = ~SPACE[raw]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        edge = at[1:-1]
        edge = edge[edge < len(raw)]
        first[edge] = inside[edge]  # a text's first byte begins a token even right after another text's last
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        back = edge[edge > 0] - 1
        last[back] = inside[back]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.inside = inside
        self.doc = np.searchsorted(at, self.start, side="right") - 1

    def __len__(self) -> int:
        return len(self.start)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sum of a value of each byte over each token."""
        if not len(self):
            return np.zeros(0, values.dtype)
        total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values, dtype=values.dtype)])
        return total[self.end] - total[self.start]

    def count(self, kind: np.ndarray) -> np.ndarray:
        """Bytes of a kind (a table of 256 booleans) in each token."""
        return self.sums(kind[self.raw].astype(np.int32))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of the bytes of each token and their places."""
        n = self.end - self.start
        place = np.arange(len(self.raw)) - np.repeat(*_fill(self.start, n, len(self.raw)))
        value = _BYTE[self.raw] * _PLACE[place & 63]
        return mix(self.sums(value) + n.astype(np.uint64))


def _fill(start: np.ndarray, n: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Arguments of np.repeat that give, at each byte, where its token began; bytes between tokens belong to the one before."""
    if not len(start):
        return np.zeros(1, np.int64), np.array([size])
    edges = np.r_[0, start[1:], size]
    return start, np.diff(edges)
