"""Elias-Fano coded monotone sequences as numpy arrays that can be memory-mapped.

A sequence of n values below u keeps the low bits of each value packed, and the high parts in unary:
the i-th value sets bit (value >> low) + i.  Counts of ones before every 64-bit word let ``access`` and
``rank`` of whole batches find their word by one search and their bit by halving the word.
"""

from __future__ import annotations

import numpy as np

ONE = np.uint64(1)
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """Values of ``width`` bits one after the other in 64-bit words."""
    words = np.zeros(len(values) * width // 64 + 2, np.uint64)
    if width:
        at = np.arange(len(values), dtype=np.uint64) * np.uint64(width)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        np.bitwise_or.at(words, word, values << shift)
        over = np.flatnonzero(shift + np.uint64(width) > 64)
        np.bitwise_or.at(words, word[over] + 1, values[over] >> (np.uint64(64) - shift[over]))
    return words


def unpack(words: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """The values at the given places of a packed array."""
    if not width:
        return np.zeros(len(at), np.uint64)
    bit = at.astype(np.uint64) * np.uint64(width)
    word, shift = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
    low = words[word] >> shift
    high = np.where(shift > 0, words[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
    return (low | high) & (ALL >> np.uint64(64 - width))


def select_in_word(word: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Position of the k-th (from 0) set bit of each word."""
    k, place = k.astype(np.int64), np.zeros(len(word), np.int64)
    for half in (32, 16, 8, 4, 2, 1):
        low = word & np.uint64((1 << half) - 1)
        ones = np.bitwise_count(low).astype(np.int64)
        go = k >= ones
        k = np.where(go, k - ones, k)
        word = np.where(go, word >> np.uint64(half), low)
        place += go * half
    return place


class EliasFano:
    """A non-decreasing sequence of unsigned numbers."""

    def __init__(self, n: int, low: int, lows: np.ndarray, bits: np.ndarray, ones: np.ndarray) -> None:
        self.n, self.low, self.lows, self.bits, self.ones = n, low, lows, bits, ones
        self.zeros = np.arange(len(ones), dtype=np.int64) * 64 - ones

    @staticmethod
    def encode(values: np.ndarray, universe: int) -> EliasFano:
        n = len(values)
        low = max(0, (universe // max(n, 1)).bit_length() - 1)
        values = values.astype(np.uint64)
        at = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
        bits = np.zeros((universe >> low) // 64 + n // 64 + 3, np.uint64)
        np.bitwise_or.at(bits, at >> 6, ONE << (at & 63).astype(np.uint64))
        ones = np.concatenate(([0], np.cumsum(np.bitwise_count(bits))))[:-1].astype(np.int64)
        mask = np.uint64((1 << low) - 1)
        return EliasFano(n, low, pack(values & mask, low), bits, ones)

    def arrays(self) -> dict[str, np.ndarray]:
        return {"lows": self.lows, "bits": self.bits, "ones": self.ones}

    def access(self, i: np.ndarray) -> np.ndarray:
        """The values at the given places."""
        word = np.searchsorted(self.ones, i, side="right") - 1
        place = word * 64 + select_in_word(self.bits[word], i - self.ones[word])
        return ((place - i).astype(np.uint64) << np.uint64(self.low)) | unpack(self.lows, i, self.low)

    def before(self, high: np.ndarray) -> np.ndarray:
        """How many values have a high part below the given ones."""
        k = high.astype(np.int64) - 1
        last = np.maximum(k, 0)
        word = np.searchsorted(self.zeros, last, side="right") - 1
        place = word * 64 + select_in_word(~self.bits[word], last - self.zeros[word])
        return np.where(k < 0, 0, place - last)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """The first place whose value is at least x (n if there is none)."""
        x = x.astype(np.uint64)
        high = x >> np.uint64(self.low)
        top = np.uint64(max(0, len(self.bits) * 64 - self.n - 1))
        beyond = high >= top
        high = np.minimum(high, top - ONE if top else top)
        start, stop = self.before(high), self.before(high + ONE)
        wanted = x & np.uint64((1 << self.low) - 1)
        while True:
            open_ = np.flatnonzero(start < stop)
            if not len(open_):
                return np.where(beyond, self.n, np.minimum(start, self.n))
            middle = (start[open_] + stop[open_]) // 2
            less = unpack(self.lows, middle, self.low) < wanted[open_]
            start[open_] = np.where(less, middle + 1, start[open_])
            stop[open_] = np.where(less, stop[open_], middle)
