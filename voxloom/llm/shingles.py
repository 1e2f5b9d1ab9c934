"""Word n-grams of many texts at once, as 64-bit hashes in numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

PIECE = 4 << 20  # bytes of text handled together

_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Shingler:
    """Hashes of words and of runs of ``size`` words; a text with fewer words is one run."""

    def __init__(self, size: int, lower: bool = True, punctuation: bool = False):
        """``punctuation``: ASCII characters that are no letters or digits part words like white space."""
        self.size, self.lower = size, lower
        self.white = _WHITE.copy()
        if punctuation:
            self.white[[c for c in range(128) if not chr(c).isalnum()]] = True
        self.byte = np.random.default_rng(4).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
        self.up = self.down = np.ones(0, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                powers = np.full(n, base & _MASK, np.uint64)
                powers[0] = 1
                setattr(self, name, np.multiply.accumulate(powers))

    def words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hash, text, start, end) of each word; start and end are bytes of the joined texts with one space after each."""
        data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        if self.lower:
            data = _LOWER[data]
        n = len(data)
        self._powers(n)
        white = self.white[data]
        edge = np.flatnonzero(white[1:] != white[:-1]) + 1
        if not white[0]:
            edge = np.append(0, edge)
        start, end = edge[::2], edge[1::2]  # the data ends in white space
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.byte[data] * self.up[:n], out=sums[1:])
        hashes = mix((sums[end] - sums[start]) * self.down[start])
        bounds = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
        return hashes, np.searchsorted(bounds, start, side="right"), start, end

    def runs(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """Sorted distinct run hashes of each text."""
        hashes, owner, _, _ = self.words(texts)
        bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
        size = self.size
        if len(hashes) >= size:
            whole = np.zeros(len(hashes) - size + 1, np.uint64)
            for k in range(size):
                whole = mix(whole + hashes[k : len(hashes) - size + 1 + k]) + np.uint64(k + 1)
            whole = mix(whole)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if b - a >= size:
                yield np.unique(whole[a : b - size + 1])
            elif b > a:
                few = np.full(1, b - a, np.uint64)
                for h in hashes[a:b]:
                    few = mix(few * np.uint64(31) + h)
                yield few
            else:
                yield np.zeros(0, np.uint64)


def pieces(texts, limit: int = PIECE) -> Iterator[list[bytes]]:
    """Texts of an Arrow column of binaries, some MB at a time."""
    held, size = [], 0
    for text in texts:
        held.append(text.as_py())
        size += len(held[-1])
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held
