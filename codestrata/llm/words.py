"""Hashes of words and of runs of words, vectorised in numpy."""

from __future__ import annotations

import re

import numpy as np
import xxhash

#: Words that are compared without case and punctuation: runs of letters and digits.
PLAIN = re.compile(r"[^\W_]+")
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
STEP = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """word (text, or its UTF-8 bytes) -> 64-bit hash, remembered up to a bound."""

    def __init__(self, most: int = 300_000):
        super().__init__()
        self.most = most

    def __missing__(self, w: str | bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[w] = h = xxhash.xxh3_64_intdigest(w if isinstance(w, bytes) else w.encode("utf-8", "surrogatepass"))
        return h

    def of(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def grams(h: np.ndarray, q: int) -> np.ndarray:
    """Hashes of all runs of q words."""
    n = len(h) - q + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = h[:n].copy()
    for k in range(1, q):
        out = mix64(out + STEP) ^ h[k : k + n] * M1
    return mix64(out)
