"""Hashes of any ranges of a byte buffer from one pass over it: a polynomial whose value doesn't depend on the place."""

from __future__ import annotations

import hashlib

import numpy as np


def byte_table(seed: bytes, dtype=np.uint64) -> np.ndarray:
    """A random number for each byte value."""
    raw = b"".join(hashlib.blake2b(seed + bytes([i]), digest_size=8).digest() for i in range(256))
    return np.frombuffer(raw, np.uint64).astype(dtype)


_MIX = byte_table(b"mix")
_BASE = 0x9E3779B97F4A7C15  # odd, so dividing by its powers is multiplying by those of its inverse
_INVERSE = pow(_BASE, -1, 2**64)
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse; kept up to 16 MB."""
    global _powers
    if len(_powers[0]) >= n:
        return _powers[0][:n], _powers[1][:n]
    size = max(n, 1 << 16)
    made = []
    for b in (_BASE, _INVERSE):
        x = np.full(size, b, np.uint64)
        x[0] = 1
        made.append(np.cumprod(x, dtype=np.uint64))
    if size <= 1 << 20:
        _powers = tuple(made)
    return made[0][:n], made[1][:n]


class Rolling:
    """``of(start, end)``: 64-bit hashes of the ranges [start, end) of ``buf``."""

    def __init__(self, buf: np.ndarray):
        power, self.inverse = _table(len(buf) + 1)
        self.total = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_MIX[buf] * power[:-1], dtype=np.uint64, out=self.total[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        v = (self.total[end] - self.total[start]) * self.inverse[start] + (end - start).astype(np.uint64)
        v ^= v >> np.uint64(29)
        v *= np.uint64(0xBF58476D1CE4E5B9)
        v ^= v >> np.uint64(32)
        return v.view(np.int64)


def gather(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of the ranges in a row, offsets of each)."""
    size = end - start
    offsets = np.concatenate([[0], np.cumsum(size)])
    return buf[np.repeat(start - offsets[:-1], size) + np.arange(int(offsets[-1]))], offsets
