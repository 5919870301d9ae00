"""Elias-Fano sequences and a two-level n-gram trie over them."""

from __future__ import annotations

import mmap
import tempfile

import numpy as np


class Bits:
    """A packed bit string with select: the counts of ones before every 64-bit word are all that is unpacked."""

    def __init__(self, packed: np.ndarray):
        words = -(-len(packed) // 8)
        self.words = np.zeros(words, dtype="<u8")
        self.words.view(np.uint8)[: len(packed)] = packed
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(ones)]).astype(np.uint32 if words < 1 << 26 else np.int64)

    def _select(self, k: np.ndarray, before, words) -> np.ndarray:
        """Place of the k-th set bit (from 0), given the counts before each word; bits run from a byte's highest."""
        out = np.empty(len(k), dtype=np.int64)
        for lo in range(0, len(k), 1 << 15):
            part = k[lo : lo + (1 << 15)]
            word = np.searchsorted(before, part, "right") - 1
            bits = np.unpackbits(words(word).view(np.uint8).reshape(-1, 8), axis=1)
            rank = part - before[word]
            place = (np.cumsum(bits, axis=1, dtype=np.uint8) > rank[:, None]).argmax(axis=1)
            out[lo : lo + len(part)] = word * 64 + place
        return out

    def ones(self, k: np.ndarray) -> np.ndarray:
        return self._select(k, self.before, lambda w: self.words[w])

    def zeros(self, k: np.ndarray) -> np.ndarray:
        if not hasattr(self, "_zeros"):
            self._zeros = np.arange(len(self.before), dtype=np.int64) * 64 - self.before
        return self._select(k, self._zeros, lambda w: ~self.words[w])


class EliasFano:
    """A monotone sequence of unsigned integers: low bits packed, high bits in unary (one bit for each value and bucket).

    Single values and buckets are found by select over the packed bits; the sequence is never unpacked for that."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        self._bits: Bits | None = None

    @classmethod
    def of(cls, high: np.ndarray, low: np.ndarray, low_bits: int) -> EliasFano:
        """From values given as high part and low part (``low_bits`` wide), sorted."""
        n = len(high)
        bits = np.zeros(int(high[-1]) + n + 1 if n else 1, dtype=np.uint8)
        bits[high.astype(np.int64) + np.arange(n)] = 1
        return cls(n, low_bits, narrow(low, -(-low_bits // 8)), np.packbits(bits))

    @property
    def bits(self) -> Bits:
        self._bits = self._bits or Bits(self.high)
        return self._bits

    def highs(self) -> np.ndarray:
        """The high part of every value, in one pass over the unary bits."""
        return np.flatnonzero(np.unpackbits(self.high))[: self.n] - np.arange(self.n)

    def lows(self, at: np.ndarray) -> np.ndarray:
        return wide(self.low[at])

    def access(self, at: np.ndarray) -> np.ndarray:
        """The values at given places."""
        high = (self.bits.ones(at) - at).astype(np.uint64)
        return (high << np.uint64(self.low_bits)) | self.lows(at)

    def find(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Index of each value, -1 where the sequence lacks it: the successor search within the value's bucket."""
        if not self.n:
            return np.full(len(high), -1, dtype=np.int64)
        h, last = high.astype(np.int64), int(self.bits.ones(np.array([self.n - 1]))[0]) - (self.n - 1)
        known = h <= last
        lo, hi = np.zeros(len(h), dtype=np.int64), np.zeros(len(h), dtype=np.int64)
        own = np.flatnonzero(known)
        # Bucket b lies between the zeros b - 1 and b; the last one has no zero behind it.
        some = own[h[own] > 0]
        lo[some] = self.bits.zeros(h[some] - 1) - (h[some] - 1)
        hi[own] = self.n
        some = own[h[own] < last]
        hi[some] = self.bits.zeros(h[some]) - h[some]
        return search(self.low, lo, hi, low)

    def arrays(self) -> list[np.ndarray]:
        return [np.array([self.n, self.low_bits, self.low.shape[1]], dtype="<i8"), self.low.reshape(-1), self.high]


def narrow(x: np.ndarray, width: int) -> np.ndarray:
    """Numbers as ``width`` bytes each."""
    return x.astype("<u8").view(np.uint8).reshape(len(x), 8)[:, :width].copy() if len(x) else np.zeros((0, width), np.uint8)


def wide(x: np.ndarray) -> np.ndarray:
    out = np.zeros((len(x), 8), dtype=np.uint8)
    out[:, : x.shape[1]] = x
    return out.reshape(-1).view("<u8")


def search(low: np.ndarray, lo: np.ndarray, hi: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Where in its range [lo, hi) of packed sorted numbers each value is, or -1: a binary search, all at once."""
    left, right, out = lo.copy(), hi.copy(), np.full(len(lo), -1, dtype=np.int64)
    open_ = np.flatnonzero(left < right)
    while len(open_):
        mid = (left[open_] + right[open_]) >> 1
        less = wide(low[mid]) < value[open_]
        left[open_[less]], right[open_[~less]] = mid[less] + 1, mid[~less]
        open_ = open_[left[open_] < right[open_]]
    hit = np.flatnonzero(left < hi)
    hit = hit[wide(low[left[hit]]) == value[hit]]
    out[hit] = left[hit]
    return out


def pack(arrays: list[np.ndarray]) -> bytes:
    """Arrays of numbers to bytes: kind and length of each, then their data."""
    head = [len(arrays)]
    for a in arrays:
        head += [ord(a.dtype.kind) * 16 + a.dtype.itemsize, len(a)]
    return np.array(head, dtype="<i8").tobytes() + b"".join(a.tobytes() for a in arrays)


def unpack(data) -> list[np.ndarray]:
    n = int(np.frombuffer(data, "<i8", 1)[0])
    head, at, out = np.frombuffer(data, "<i8", 2 * n, 8).reshape(n, 2), 8 + 16 * n, []
    for kind, size in head.tolist():
        t = np.dtype(f"<{chr(kind // 16)}{kind % 16}")
        out.append(np.frombuffer(data, t, size, at))
        at += size * t.itemsize
    return out


SUCCESSOR_BITS, CONTEXT_BITS, POINTER_LOW = 40, 64, 8


class Trie:
    """Contexts (64-bit word hashes, with exact counts) and, relative to each, successors with quantised probabilities.

    The contexts are an Elias-Fano sequence. So are the pointers, which are monotone: the successors of context c stand from
    pointer c to pointer c + 1, sorted, as numbers of 40 bits. A pair is looked up by select on the pointers, which bounds
    the successor search to its context."""

    def __init__(self, contexts: EliasFano, counts: np.ndarray, kinds: np.ndarray, pointers: EliasFano, successors: np.ndarray, codes: np.ndarray, book: np.ndarray):
        self.contexts, self.counts, self.kinds, self.pointers, self.successors, self.codes, self.book = contexts, counts, kinds, pointers, successors, codes, book

    @classmethod
    def build(cls, words: np.ndarray, counts: np.ndarray, kinds: np.ndarray, owner: np.ndarray, successor: np.ndarray, value: np.ndarray) -> Trie:
        """words: sorted context hashes; counts, kinds: occurrences and different successors of each; the rest: context
        number, 40-bit successor and positive value of each stored pair, sorted by the first two."""
        c_low = max(8, CONTEXT_BITS - max(1, len(words)).bit_length())
        contexts = EliasFano.of(words >> np.uint64(c_low), words & np.uint64((1 << c_low) - 1), c_low)
        ends = np.searchsorted(owner, np.arange(len(words) + 1)).astype(np.uint64)
        pointers = EliasFano.of(ends >> np.uint64(POINTER_LOW), ends & np.uint64((1 << POINTER_LOW) - 1), POINTER_LOW)
        logs = np.log10(value) if len(value) else np.zeros(0)
        lo, hi = (float(logs.min()), float(logs.max())) if len(logs) else (0.0, 0.0)
        step = (hi - lo) / 255 or 1.0
        codes = np.rint((logs - lo) / step).astype(np.uint8)
        return cls(contexts, counts.astype("<i8"), kinds.astype("<i8"), pointers, narrow(successor, SUCCESSOR_BITS // 8), codes, np.array([lo, step]))

    def context(self, words: np.ndarray) -> np.ndarray:
        c_low = self.contexts.low_bits
        return self.contexts.find(words >> np.uint64(c_low), words & np.uint64((1 << c_low) - 1))

    def values(self, context: np.ndarray, pairs: np.ndarray, successor: np.ndarray) -> np.ndarray:
        """The stored value of each pair: ``pairs`` successors for each context, one after the other; 0 where the trie
        lacks the pair or the context is -1."""
        own = np.maximum(context, 0)
        lo, hi = (self.pointers.access(x).astype(np.int64) for x in (own, own + 1)) if len(self.counts) else (np.zeros(len(own), np.int64),) * 2
        hi = np.where(context >= 0, hi, lo)
        at = search(self.successors, np.repeat(lo, pairs), np.repeat(hi, pairs), successor)
        out, hit = np.zeros(len(successor)), np.flatnonzero(at >= 0)
        out[hit] = 10 ** (self.book[0] + self.book[1] * self.codes[at[hit]])
        return out

    def words(self) -> np.ndarray:
        return (self.contexts.highs().astype(np.uint64) << np.uint64(self.contexts.low_bits)) | wide(self.contexts.low)

    def stored(self) -> np.ndarray:
        """The 40-bit successor of each stored pair."""
        return wide(self.successors)

    def to_bytes(self) -> bytes:
        small = lambda a: a.astype("<u4") if not len(a) or a.max() < 1 << 32 else a
        return pack([*self.contexts.arrays(), *self.pointers.arrays(), self.successors.reshape(-1), small(self.counts), small(self.kinds), self.codes, self.book.astype("<f8")])

    @classmethod
    def load(cls, data) -> Trie:
        a = unpack(data)

        def sequence(i):
            n, low_bits, width = a[i].tolist()
            return EliasFano(n, low_bits, a[i + 1].reshape(n, width), a[i + 2])

        return cls(sequence(0), a[7], a[8], sequence(3), a[6].reshape(-1, SUCCESSOR_BITS // 8), a[9], a[10])

    @classmethod
    def mapped(cls, data: bytes) -> Trie:
        """Load from a memory-mapped file without a name, which the system removes when it is closed."""
        with tempfile.TemporaryFile() as f:
            f.write(data)
            f.flush()
            return cls.load(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))
