"""Words of whole batches of texts as numbers, with numpy, for operators that look at every word."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
ALNUM = bytes(32 if b < 128 and not (48 <= b < 58 or 97 <= b < 123) else b
              for b in (c + 32 if 65 <= c < 91 else c for c in range(256)))
"""Lower-cases A-Z and blanks all ASCII but letters and digits; other bytes belong to words."""

_MULTIPLIER = 0x9E3779B97F4A7C15
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def raw_texts(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The UTF-8 bytes of each text; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(10, (n - 1).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        inverse = pow(_MULTIPLIER, -1, 1 << 64)
        both = []
        for base in (_MULTIPLIER, inverse):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            both.append(np.multiply.accumulate(steps))
        _POWERS[size] = (both[0], both[1])
    return _POWERS[size]


def hash_words(texts: Sequence[bytes], table: bytes | None = ALNUM) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in order, and the number of words of each text.

    A word's hash is a polynomial in its bytes, taken from running sums, so there is no loop over
    words.  Without a table, words lie between ASCII white space and keep their case.
    """
    joined = b" ".join(texts)
    joined = joined.translate(table) if table else joined
    data = np.frombuffer(joined, dtype=np.uint8)
    if not len(data):
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    inside = data != 32 if table else (data != 32) & ((data < 9) | (data > 13))
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    starts, stops = edges[::2], edges[1::2]
    powers, inverse = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:len(data)], out=sums[1:])
    hashes = mix64((sums[stops] - sums[starts]) * inverse[starts] + (stops - starts).astype(np.uint64))
    ends = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.searchsorted(starts, ends), prepend=0)
    return hashes, counts


def blocks(texts: Sequence[bytes], size: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes each; a longer text is a range of its own."""
    start, total = 0, 0
    for i, text in enumerate(texts):
        if total and total + len(text) > size:
            yield start, i
            start, total = i, 0
        total += len(text)
    if start < len(texts):
        yield start, len(texts)


def shingles(hashes: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words and their number per text; a text of fewer words has one, none if empty."""
    if not len(hashes):
        return np.empty(0, np.uint64), np.zeros(len(counts), np.int64)
    rolled = np.zeros(len(hashes), np.uint64)
    factor = 1
    bounds = np.concatenate(([0], np.cumsum(counts)))
    owner = np.repeat(np.arange(len(counts)), counts)
    left = bounds[owner + 1] - np.arange(len(hashes))
    for j in range(min(k, len(hashes))):
        factor = (factor * 0xD6E8FEB86659FD93 + 2 * j + 1) & 0xFFFFFFFFFFFFFFFF
        part = np.zeros(len(hashes), np.uint64)
        part[:len(hashes) - j] = hashes[j:] * np.uint64(factor)
        rolled += np.where(left > j, part, np.uint64(0))
    first = np.zeros(len(hashes), bool)
    first[bounds[:-1][counts > 0]] = True
    whole = (left >= k) | first
    made = np.bincount(owner[whole], minlength=len(counts)) if len(owner) else np.zeros(len(counts), np.int64)
    return mix64(rolled[whole]), made.astype(np.int64)
