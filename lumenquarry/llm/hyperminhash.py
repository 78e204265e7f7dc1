"""Shingle sets and HyperMinHash registers of texts, in numpy.

A register keeps the smallest hash of a set under one hash function, compressed to its number of leading
zeros (6 bits) and the 10 bits after the first one. Equal registers of two sets are as likely as their Jaccard
similarity, but for chance collisions of the compressed values, whose rate is known and taken off.
"""

from __future__ import annotations

import numpy as np
import xxhash

K = 96
ROWS = 4
BANDS = K // ROWS
MANTISSA = 10
#: Chance that two unrelated registers agree, for equal large sets, times 2**MANTISSA (published with the sketch).
COLLISION = 0.16991948715973909

_rng = np.random.Generator(np.random.PCG64(20240229))
_MUL = _rng.integers(0, 2**64, K, np.uint64) | np.uint64(1)
_ADD = _rng.integers(0, 2**64, K, np.uint64)
_CHAIN = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles: runs of `width` words, ASCII letters lower-cased.

    Fewer words: the whole sequence is one shingle. No words: empty. Words are split at ASCII white space.
    """
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(width, len(words))
    out = h[: len(h) - n + 1].copy()
    for j in range(1, n):
        out = _mix(out * _CHAIN + np.uint64(j)) + h[j : len(h) - n + 1 + j]
    return np.unique(_mix(out + np.uint64(n)))


def registers(hashes: np.ndarray) -> np.ndarray:
    """K registers (uint16) of a set that isn't empty."""
    low = np.full(K, 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), 512):
        part = hashes[at : at + 512]
        np.minimum(low, (_MUL[:, None] * part[None, :] + _ADD[:, None]).min(axis=1), out=low)
    # the position of the leading one, exactly: halve the range six times
    zeros, x = np.zeros(K, np.uint64), low.copy()
    for step in (32, 16, 8, 4, 2, 1):
        s = np.uint64(step)
        free = x < (np.uint64(1) << np.uint64(64 - step))
        zeros[free] += s
        x[free] <<= s
    mantissa = (x >> np.uint64(63 - MANTISSA)) & np.uint64(2**MANTISSA - 1)
    return ((zeros << np.uint64(MANTISSA)) | mantissa).astype(np.uint16)


def estimate(equal: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the share of equal registers of sets with n and m members, chance collisions taken off."""
    ratio = n / m
    chance = COLLISION * 2.0**-MANTISSA * 4 * ratio / (1 + ratio) ** 2
    return (equal - chance) / (1 - chance)


def floor_estimate(threshold: float) -> float:
    """An estimate six standard deviations under the threshold; pairs below it aren't verified."""
    return threshold - 6 * (threshold * (1 - threshold) / K) ** 0.5
