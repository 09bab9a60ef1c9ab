"""64-bit hashes of words and of word n-grams, the same in every task."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words that a task remembers, at most so many.
CACHE = 250_000
_ODD, _MIX1, _MIX2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
MASK = (1 << 64) - 1


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = made = xxhash.xxh3_64_intdigest(word)
        return made

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(_MIX1)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(_MIX2)
    return h ^ (h >> np.uint64(31))


class Grams:
    """Hashes of all n-grams of a sequence by one running sum, with powers kept between calls."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def _grow(self, n: int) -> None:
        inverse = pow(_ODD, -1, 1 << 64)
        while len(self.up) < n + 1:
            size = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(_ODD, size, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(inverse, size, 1 << 64))])

    def of(self, hashes: np.ndarray, width: int) -> np.ndarray:
        n = len(hashes)
        if n < width:
            return np.empty(0, dtype=np.uint64)
        self._grow(n)
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mixed(hashes) * self.up[:n], dtype=np.uint64)])
        return mixed((sums[width:] - sums[:-width]) * self.down[: n - width + 1])


def signed_hash(data: bytes) -> int:
    """A 64-bit hash as Spark's long."""
    h = xxhash.xxh3_64_intdigest(data)
    return h - (1 << 64) if h >> 63 else h
