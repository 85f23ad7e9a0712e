"""Random draws keyed by row, as column expressions.

A draw is a pure function of ``(seed, key columns)``.  It does not depend on how the rows are
partitioned, a retried task repeats it exactly, and no state is kept between rows.

Two generators are available:

* ``md5``: 52 bits of an MD5 digest.  Every SQL engine can repeat it, so the deterministic checks
  use it.  It is also the generator for privacy noise, where cells are few.
* ``xxhash64``: about twelve times cheaper per row, for draws that are mere post-processing of an
  already private model (sampling rows, filling foreign keys, bootstraps).

Seeded noise is repeatable and therefore gives no privacy once the seed is known: for a real
release, ``seed`` must be a fresh secret that is thrown away afterwards.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_52 = float(2**52)


def as_column(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


@dataclass(frozen=True)
class Draws:
    """A seed and a generator; methods build column expressions."""

    seed: int | str = 42
    generator: str = "md5"

    def uniform(self, *key) -> Column:
        """Uniform draw, strictly between 0 and 1, for the given key parts."""
        parts = [F.lit(str(self.seed))] + [as_column(k) for k in key]
        if self.generator == "md5":
            texts = [self.seed, *key]  # leading constants are one text, put together once
            n = next((i for i, t in enumerate(texts) if type(t) not in (str, int)), len(texts))
            digest = F.md5(F.concat_ws(":", F.lit(":".join(map(str, texts[:n]))), *[p.cast("string") for p in parts[n:]]))
            bits = F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint").cast("double")
        elif self.generator == "xxhash64":
            bits = F.shiftrightunsigned(F.xxhash64(*parts), 12).cast("double")
        else:
            raise ValueError(f"unknown generator {self.generator!r}")
        return (bits + 0.5) / TWO_52

    def laplace(self, scale, *key) -> Column:
        return laplace_from_uniform(self.uniform(*key), scale)


def laplace_from_uniform(u: Column, scale) -> Column:
    """Inverse distribution function of the Laplace law with mean 0."""
    centred = u - 0.5
    return -as_column(scale) * F.signum(centred) * F.log(1.0 - 2.0 * F.abs(centred))


def index_draw(u: Column, size) -> Column:
    """Uniform integer in ``[0, size)``."""
    size = as_column(size)
    return F.least(F.floor(u * size), size - 1).cast("bigint")


def integer_draw(u: Column, lo, hi) -> Column:
    """Uniform integer in ``[lo, hi)``."""
    lo, hi = as_column(lo), as_column(hi)
    return F.least(F.floor(lo + u * (hi - lo)), hi - 1).cast("bigint")


def real_draw(u: Column, lo, hi, digits: int) -> Column:
    """Uniform real in ``[lo, hi)``, rounded."""
    lo, hi = as_column(lo), as_column(hi)
    return F.round(lo + u * (hi - lo), digits)


def choice_draw(u: Column, values: Sequence | Column) -> Column:
    """Uniform pick from a list of literals or from an array column."""
    if not isinstance(values, Column):
        values = F.array(*[F.lit(v) for v in values])
    return F.element_at(values, (index_draw(u, F.size(values)) + 1).cast("int"))


def cumulative(weights: Sequence[float]) -> list[float]:
    """Running shares of the weights, the last one exactly 1."""
    total, run, out = float(sum(weights)), 0.0, []
    for w in weights:
        run += w
        out.append(run / total)
    out[-1] = 1.0
    return out


def count_at_most(x: Column, ascending: Column, width: int) -> Column:
    """How many entries of an ascending array of at most ``width`` entries are at most ``x``.

    A binary search of fixed depth.  Both arguments are bound once through a one-element array, so
    that an expensive draw is not evaluated again at every step.
    """
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(max(width, 1).bit_length()))])
    bound = F.array(F.struct(x.alias("x"), ascending.alias("a")))

    def search(s):
        return F.aggregate(steps, F.lit(0), lambda found, step: F.when(
            F.get(s["a"], found + step - 1) <= s["x"], found + step).otherwise(found))
    return F.element_at(F.transform(bound, search), 1)


def step_index(u: Column, cdf: Column, width: int) -> Column:
    """The drawn position: entries of the cumulative array that are at most ``u``, kept inside."""
    return F.least(count_at_most(u, cdf, width), F.size(cdf) - 1)


def double_array(values: Sequence[float]) -> Column:
    """Literal array of doubles, built in one call however long it is."""
    texts = [f"{float(v)!r}D" if math.isfinite(v) else f"double('{float(v)!r}')" for v in values]
    return F.expr(f"cast(array({', '.join(texts)}) as array<double>)")


def weighted_choice_draw(u: Column, values: Sequence, weights: Sequence[float]) -> Column:
    """Pick from a list of literals with given weights."""
    cdf = double_array(cumulative(weights))
    return F.element_at(F.array(*[F.lit(v) for v in values]), step_index(u, cdf, len(values)) + 1)


# Coefficients of the published rational approximation of the normal quantile
# (P. J. Acklam, 2003), relative error below 1.15e-9.
NORMAL_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02,
            1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
NORMAL_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02,
            6.680131188771972e01, -1.328068155288572e01)
NORMAL_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00,
            -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
NORMAL_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00,
            3.754408661907416e00)
NORMAL_TAIL = 0.02425


def _horner(coefficients: Sequence[float], x: Column) -> Column:
    acc = F.lit(coefficients[0])
    for c in coefficients[1:]:
        acc = acc * x + c
    return acc


def normal_quantile(p: Column) -> Column:
    """Standard normal quantile of a probability strictly between 0 and 1."""
    q = p - 0.5
    r = q * q
    middle = _horner(NORMAL_A, r) * q / (_horner(NORMAL_B, r) * r + 1.0)
    tail = F.sqrt(-2.0 * F.log(F.least(p, 1.0 - p)))
    far = _horner(NORMAL_C, tail) / (_horner(NORMAL_D, tail) * tail + 1.0)
    return (F.when(p < NORMAL_TAIL, far)
            .when(p > 1.0 - NORMAL_TAIL, -far)
            .otherwise(middle))


def normal_pair(u: Column, v: Column) -> tuple[Column, Column]:
    """Two independent standard normal draws from two uniform ones (Box and Muller)."""
    radius, angle = F.sqrt(-2.0 * F.log(u)), v * (2.0 * math.pi)
    return radius * F.cos(angle), radius * F.sin(angle)


# A rational approximation of the normal distribution function to double precision.
CDF_TOP = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
CDF_BOTTOM = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831,
              793.826512519948, 440.413735824752)


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function."""
    size = F.abs(x)
    bell = F.exp(-size * size / 2)
    far = size + 1 / (size + 2 / (size + 3 / (size + 4 / (size + 0.65))))
    below = F.when(size < 7.07, bell * _horner(CDF_TOP, size) / _horner(CDF_BOTTOM, size)).otherwise(bell / far / 2.506628274631)
    return F.when(x > 0, 1 - below).otherwise(below)


def box_muller(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``normal_pair`` of a batch."""
    radius, angle = np.sqrt(-2.0 * np.log(u)), v * (2.0 * math.pi)
    return radius * np.cos(angle), radius * np.sin(angle)


def normal_cdf_of(x: np.ndarray) -> np.ndarray:
    """``normal_cdf`` of a batch."""
    size = np.abs(x)
    bell = np.exp(-size * size / 2)
    far = size + 1 / (size + 2 / (size + 3 / (size + 4 / (size + 0.65))))
    below = np.where(size < 7.07, bell * np.polyval(CDF_TOP, size) / np.polyval(CDF_BOTTOM, size), bell / far / 2.506628274631)
    return np.where(x > 0, 1 - below, below)


# Fixed values of MD5 (RFC 1321): sines as 32-bit words, rotations, and which word of the block a step takes.
MD5_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
MD5_TURNS = [t for turns in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for _ in range(4) for t in turns]
MD5_WORDS = [(i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16 for i in range(64)]
MD5_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
BLOCK_BYTES = 55
"""Longest text that is one block of MD5."""


def md5_heads(block: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The first 52 bits of the MD5 of texts, rows of 64 bytes of which ``sizes`` (at most 55) count and the rest are 0."""
    block[np.arange(len(block)), sizes] = 0x80
    words = np.ascontiguousarray(block.view("<u4").T)
    words[14] = sizes * 8
    a, b, c, d = (np.full(len(block), x, np.uint32) for x in MD5_START)
    for i in range(64):
        if i < 16:
            f = d ^ (b & (c ^ d))
        elif i < 32:
            f = c ^ (d & (b ^ c))
        elif i < 48:
            f = b ^ c ^ d
        else:
            f = c ^ (b | ~d)
        f += a
        f += words[MD5_WORDS[i]]
        f += np.uint32(MD5_SINES[i])
        turn = np.uint32(MD5_TURNS[i])
        a, d, c, b = d, c, b, b + (f << turn | f >> (np.uint32(32) - turn))
    first, second = ((x + np.uint32(s)).byteswap().astype(np.uint64) for x, s in ((a, MD5_START[0]), (b, MD5_START[1])))
    return (first << np.uint64(32) | second) >> np.uint64(12)


def uniforms_of(draws: Draws, ids: np.ndarray, keys: Sequence[Sequence]) -> list[np.ndarray]:
    """``draws.uniform(*key, id)`` by MD5 of a batch of whole numbers, for each key; a text longer than a block is hashed by itself."""
    tails = np.array([b"%d" % i for i in ids.tolist()], "S")
    digits, lengths = tails.view(np.uint8).reshape(len(ids), -1), np.char.str_len(tails)
    out = []
    for key in keys:
        head = ":".join(map(str, (draws.seed, *key, ""))).encode()
        if len(head) + digits.shape[1] > BLOCK_BYTES:
            bits = np.array([int(hashlib.md5(head + t).hexdigest()[:13], 16) for t in tails.tolist()], np.uint64)
        else:
            block = np.zeros((len(ids), 64), np.uint8)
            block[:, :len(head)] = np.frombuffer(head, np.uint8)
            block[:, len(head):len(head) + digits.shape[1]] = digits
            bits = md5_heads(block, lengths + len(head))
        out.append((bits.astype(float) + 0.5) / TWO_52)
    return out
