"""Byte-level text kernels shared by the operators: words, word hashes, shingle sets.

All work on UTF-8 bytes: bytes.split() splits on exactly [\\x20\\x09-\\x0D] and
bytes.lower() changes exactly A-Z.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

MASK = (1 << 64) - 1


def utf8(column) -> list:
    """Bytes (or None) of each value of an Arrow string column, without decoding."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type):
        return column.cast(pa.large_binary()).to_pylist()
    return column.cast(pa.binary()).to_pylist()


class WordHashes(dict):
    """Word -> 64-bit hash; a cache that starts anew when it has grown to `bound` words."""

    def __init__(self, bound: int = 200_000):
        super().__init__()
        self.bound = bound

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.bound:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 (public domain), in place."""
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def shingle_set(text: bytes | None, width: int, cache: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; fewer words than `width` are one shingle."""
    words = text.lower().split() if text else []
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(cache.__getitem__, words), np.uint64, n)
    if n < width:
        return mix(np.array([xxhash.xxh3_64_intdigest(h.tobytes(), seed=n)], np.uint64))
    out = h[: n - width + 1].copy()
    for k in range(1, width):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
        out += h[k : n - width + 1 + k]
    out = np.unique(mix(out))
    return out
