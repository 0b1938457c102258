"""Hashed word-shingle sets, in numpy, inside tasks.

Words are runs of bytes other than ASCII white space after A-Z are lower-cased; a set holds one 64-bit hash for each
distinct run of SIZE words, or for the whole sequence of a shorter text.
"""

from __future__ import annotations

import numpy as np

SIZE = 5
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = np.uint64(0xD6E8FEB86659FD93)
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _grow(n: int) -> None:
    global _powers, _inverse
    if len(_powers) < n:
        size = max(n, 2 * len(_powers), 1 << 16)
        inverse = pow(_BASE, -1, 1 << 64)
        _powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, _BASE, np.uint64)]), dtype=np.uint64)
        _inverse = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, inverse, np.uint64)]), dtype=np.uint64)


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word, in order."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER)
    if not data:
        return np.zeros(0, np.uint64)
    b = np.frombuffer(data, np.uint8)
    _grow(len(b) + 1)
    inside = np.empty(len(b) + 2, np.int8)
    inside[0] = inside[-1] = 0
    inside[1:-1] = ~_SPACE[b]
    edge = np.flatnonzero(np.diff(inside))
    start, end = edge[0::2], edge[1::2]
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(mix(b.astype(np.uint64) + np.uint64(1)) * _powers[: len(b)], out=total[1:])
    return mix((total[end] - total[start]) * _inverse[start] + (end - start).astype(np.uint64))


def shingle_set(text: str | None, size: int = SIZE) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    w = word_hashes(text)
    if not len(w):
        return w
    n = min(size, len(w))
    h = w[: len(w) - n + 1].copy()
    for j in range(1, n):
        h = h * _STEP + w[j : len(w) - n + 1 + j]
    return np.unique(mix(h + np.uint64(n)))
