"""Word positions, word hashes and shingle hashes of many texts at once, on one byte buffer."""

from __future__ import annotations

import numpy as np

SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_state: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h.copy()
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _powers(name: str, base: int, n: int) -> np.ndarray:
    have = _state.get(name)
    if have is None:
        have = np.ones(1, dtype=np.uint64)
    while have.size < n:
        have = np.concatenate([have, have * np.uint64(pow(base, have.size, 1 << 64))])
    _state[name] = have
    return have[:n]


def _symbols() -> np.ndarray:
    if "symbols" not in _state:
        _state["symbols"] = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    return _state["symbols"]


class Words:
    """Words (runs without ASCII white space) of a list of byte strings.

    ``doc`` is each word's text, ``start`` and ``end`` its bytes in ``data``,
    ``hash`` 64 bits of its bytes; ``first`` is each text's first word (n + 1 entries).
    """

    def __init__(self, texts: list[bytes]):
        self.n_texts = len(texts)
        self.data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
        space = SPACES[self.data]
        before = np.concatenate([[True], space[:-1]])
        self.start = np.flatnonzero(~space & before)
        self.end = np.flatnonzero(space & ~before)
        sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
        self.text_end = np.cumsum(sizes)
        self.doc = np.searchsorted(self.text_end, self.start, side="right")
        self.first = np.searchsorted(self.doc, np.arange(self.n_texts + 1))
        self.hash = self._hash()

    def _hash(self) -> np.ndarray:
        n = self.data.size
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_symbols()[self.data] * _powers("up", BASE, n), out=total[1:])
        inverse = _powers("down", pow(BASE, -1, 1 << 64), n)
        return mix((total[self.end] - total[self.start]) * inverse[self.start])

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``size`` words and the text of each; a shorter text with words is one shingle."""
        m = self.hash.size
        combined = np.zeros(m, dtype=np.uint64)
        for k in range(size):
            shifted = np.zeros(m, dtype=np.uint64)
            shifted[: max(m - k, 0)] = self.hash[k:]
            combined += mix(shifted + np.uint64(k + 1)) * np.uint64(((2 * k + 3) * 0xA0761D6478BD642F | 1) & _MASK)
        counts = np.diff(self.first)
        whole = np.arange(m) + size <= self.first[self.doc + 1] if m else np.zeros(0, dtype=bool)
        keep = whole.copy()
        short = np.flatnonzero((counts > 0) & (counts < size))
        for d in short:
            a, b = self.first[d], self.first[d + 1]
            value = np.array([counts[d]], dtype=np.uint64)
            for h in self.hash[a:b]:
                value = mix(value + np.array([h]) * np.uint64(BASE))
            combined[a] = value[0]
            keep[a] = True
        return mix(combined)[keep], self.doc[keep]
