"""Words and hashed word sequences of one text, as numpy arrays.

Words are the runs of characters outside space and \\x09-\\x0D: what bytes.split() gives.
"""

from __future__ import annotations

import numpy as np

SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[list(SPACES)] = True
_BYTE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 2**64)
_STEP = np.random.default_rng(977).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, _INVERSE)):
            table = np.full(size, base, dtype=np.uint64)
            table[0] = 1
            _powers[k] = np.multiply.accumulate(table)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_bounds(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets at which the words of raw begin and end."""
    word = ~_SPACE[np.frombuffer(raw, dtype=np.uint8)]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).view(np.int8)))
    return edge[::2], edge[1::2]


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial over random byte values, mixed."""
    if not raw:
        return np.zeros(0, dtype=np.uint64)
    begin, end = word_bounds(raw)
    power, inverse = _power_tables(len(raw) + 1)
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[np.frombuffer(raw, dtype=np.uint8)] * power[:-1], out=total[1:])
    return mix((total[end] - total[begin]) * inverse[begin] + (end - begin).astype(np.uint64))


def window_hashes(words: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each sequence of `length` consecutive words."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    words = mix(words ^ np.uint64(seed)) if seed else words
    total = np.full(n, 0x51_7C_C1_B7_27_22_0A_95 ^ length, dtype=np.uint64)
    for k in range(length):
        total += words[k : k + n] * _STEP[k]
    return mix(total)
