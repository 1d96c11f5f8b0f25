"""Hashes of words and of runs of words, as numpy arrays, for Python tasks."""

from __future__ import annotations

import numpy as np
from xxhash import xxh3_64_intdigest

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over all bits."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def words(text: str | None, lower: bool = False) -> list[bytes]:
    """Words in UTF-8; ``bytes.split`` parts them at exactly the ASCII white space that the contracts name."""
    data = text.encode("utf-8", "surrogatepass") if text else b""
    return (data.translate(_LOWER) if lower else data).split()


def hashes(found: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh3_64_intdigest, found), np.uint64, len(found))


def runs(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """A hash of each ``k`` consecutive word hashes; none if there are fewer."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.full(n, np.uint64(seed + k), np.uint64)
    for j in range(k):
        total = total * _A + h[j : j + n]
        total ^= total >> np.uint64(29)
    return mixed(total)
