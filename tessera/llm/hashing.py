"""Rolling hashes in numpy: of words, word n-grams and byte windows, all modulo 2**64.

A byte string b[0..n) has the prefix sums P[i] = sum(T[b[j]] * B**j for j < i), so the hash of b[s:e]
is (P[e] - P[s]) * B**-s, then mixed. T holds one pseudo-random number per byte, B is odd.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
BASE = _U(0x9E3779B97F4A7C15)
BASE_INVERSE = _U(pow(int(BASE), -1, 1 << 64))
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True  # word breaks, as in the rule [^\x20\x09-\x0D]+


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


BYTE = mix(np.arange(1, 257, dtype=_U) * BASE)
_POWERS = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**n-1, kept for the next call."""
    have = _POWERS.get(int(base))
    if have is None or len(have) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        have = np.full(size, base, _U)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 1 << 20:
            _POWERS[int(base)] = have
    return have[:n]


def prefix(data: np.ndarray) -> np.ndarray:
    """P[0..n] of uint8 data."""
    out = np.zeros(len(data) + 1, _U)
    np.cumsum(BYTE[data] * powers(BASE, len(data)), out=out[1:])
    return out


def spans_hash(p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte spans [start, end); equal bytes have equal hashes wherever they stand."""
    inverse = powers(BASE_INVERSE, len(p))
    return mix((p[end] - p[start]) * inverse[start] + (end - start).astype(_U))


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of uint8 data."""
    edge = np.flatnonzero(np.diff(np.concatenate(([True], SPACE[data], [True])).view(np.int8)))
    return edge[::2], edge[1::2]


def word_hashes(data: np.ndarray) -> np.ndarray:
    start, end = word_spans(data)
    return spans_hash(prefix(data), start, end) if len(start) else np.zeros(0, _U)


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash for each window of n words, rolled over the word hashes."""
    k = len(words) - n + 1
    if k <= 0:
        return np.zeros(0, _U)
    out = words[:k].copy()
    for j in range(1, n):
        out *= BASE
        out += words[j : j + k]
    return mix(out)


def repeats(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each item whether its value occurs twice or more, and whether it occurred earlier."""
    if len(x) < 2:
        return np.zeros(len(x), bool), np.zeros(len(x), bool)
    order = np.argsort(x, kind="stable")
    same = x[order][1:] == x[order][:-1]
    again, later = np.zeros(len(x), bool), np.zeros(len(x), bool)
    later[order[1:]] = same
    again[order] = np.concatenate((same, [False])) | np.concatenate(([False], same))
    return again, later


def covered(starts: np.ndarray, length: int, size: int) -> np.ndarray:
    """Which of size places lie in a window of that length that begins at a place marked in starts."""
    if not len(starts) or not starts.any():
        return np.zeros(size, bool)
    step = np.zeros(size + 1, np.int32)
    at = np.flatnonzero(starts)
    np.add.at(step, at, 1)
    np.add.at(step, np.minimum(at + length, size), -1)
    return np.cumsum(step[:size]) > 0
