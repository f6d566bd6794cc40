"""Keyed random numbers and permutations that need no state: each value follows from its key and its place alone."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np

_U = np.uint64
ROUNDS = 6


def key(*parts) -> int:
    """A 64-bit key of its parts."""
    text = "|".join(map(str, parts)).encode()
    return zlib.crc32(text) << 32 | zlib.crc32(text[::-1] + b"|")


def scramble(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (two multiplications and three shifts), element by element."""
    x = np.asarray(x, _U).copy()
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> _U(shift)
        x *= _U(by)
    return x ^ (x >> _U(31))


def draw(k: int, place: np.ndarray, below: int) -> np.ndarray:
    """Whole numbers from 0 to below - 1, one for each place."""
    return (scramble(scramble(np.asarray(place, _U) + _U(1)) ^ _U(k)) % _U(below)).astype(np.int64)


def permuted(k: int, place: np.ndarray, n: int) -> np.ndarray:
    """Where the keyed permutation of 0 .. n - 1 puts each place.

    A Feistel network over the smallest even number of bits that holds n, walked on until the result is below n: a
    permutation whatever n is, and no place has to know another. A round's function takes half of the bits, so for many
    places its values are looked up.
    """
    half = _U(max(1, ((n - 1).bit_length() + 1) // 2))
    low = (_U(1) << half) - _U(1)
    keys = scramble(np.arange(1, ROUNDS + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) ^ _U(k))
    out = np.asarray(place, _U).copy()
    todo = np.arange(len(out))
    tables = scramble(np.arange(int(low) + 1, dtype=_U) ^ keys[:, None]) & low if len(out) > int(low) else None
    while len(todo):
        left, right = out[todo] >> half, out[todo] & low
        for k, r in enumerate(keys):
            left, right = right, left ^ (scramble(right ^ r) & low if tables is None else tables[k].take(right.astype(np.int64)))
        out[todo] = left << half | right
        todo = todo[out[todo] >= _U(n)]
    return out.astype(np.int64)


def resampled_pieces(text: str, n: int, piece: int = 1 << 16) -> Iterator[np.ndarray]:
    """n whole numbers from 0 to n - 1 in pieces, drawn with replacement: mixed in 32 bits from the first 8 hex digits of md5(text).

    Products stay below 2^63, so that an engine with 64-bit whole numbers makes the same; here 32 bits wrap around.
    """
    first, by, mix = int(hashlib.md5(text.encode()).hexdigest()[:8], 16), 2654435769, np.uint32(73244475)
    steps, half = np.arange(min(n, piece), dtype=np.uint32) * np.uint32(by), np.uint32(16)
    for lo in range(0, n, piece):
        x = steps[: n - lo] + np.uint32((first + lo * by) & 0xFFFFFFFF)
        for _ in range(2):
            x = (x ^ (x >> half)) * mix
        yield (((x ^ (x >> half)).astype(_U) * _U(n)) >> _U(32)).astype(np.int64)


def resampled(text: str, n: int) -> np.ndarray:
    """The numbers of resampled_pieces in one array."""
    return np.concatenate(list(resampled_pieces(text, n))) if n else np.zeros(0, np.int64)
