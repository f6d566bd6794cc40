"""Vectorised text helpers used inside tasks: Arrow string columns to numpy bytes, words and word shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one numpy pass takes; a longer document is a pass of its own.
CHUNK = 1 << 20

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) of runs of rows with about limit bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    col = column.cast(pa.large_binary()).fill_null(b"")
    n = len(col)
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + n + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


_TABLE = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_BASE = 0x5851F42D4C957F2D
_POWERS: dict[str, np.ndarray] = {}


def _powers(name: str, base: int, n: int) -> np.ndarray:
    if name not in _POWERS or len(_POWERS[name]) < n:
        steps = np.full(max(n, CHUNK + 1), base, _U)
        steps[0] = 1
        _POWERS[name] = np.cumprod(steps, dtype=_U)
    return _POWERS[name][:n]


_BASES = (_BASE, 0x2545F4914F6CDD1D)  # two hashes that are independent of each other


def prefix_hash(data: np.ndarray, which: int = 0) -> np.ndarray:
    """Prefix sums of a polynomial hash; see span_hash."""
    out = np.zeros(len(data) + 1, _U)
    np.cumsum(mix(_TABLE + _U(which))[data] * _powers(f"up{which}", _BASES[which], len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """Hashes of data[start:end]: equal bytes give equal hashes wherever they stand."""
    down = _powers(f"down{which}", pow(_BASES[which], -1, 1 << 64), len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start])


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the words [^\\x20\\x09-\\x0D]+; words end with their document."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    inside = ~_SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:-1]
    ends[:-1] &= ~inside[1:] | first[1:-1]
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(ends) + 1, np.searchsorted(offsets, start, "right") - 1


def shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """For each document the sorted distinct 64-bit hashes of its k-word shingles.

    A-Z count as a-z. With fewer than k words the whole sequence is the only one; no words: none.
    """
    n = len(offsets) - 1
    data = _LOWER[data]
    start, end, row = words(data, offsets)
    h = span_hash(prefix_hash(data), start, end)
    per = np.bincount(row, minlength=n)
    at = np.concatenate([[0], np.cumsum(per)])
    whole = np.zeros(len(h), _U)
    for j in range(k):
        whole[: max(len(h) - j, 0)] += h[j:] * _U(0x9E3779B97F4A7C15 * (2 * j + 1) & (1 << 64) - 1)
    whole = mix(whole)
    for i in range(n):
        a, b = at[i], at[i + 1]
        if b - a >= k:
            yield np.unique(whole[a : b - k + 1])
        elif b > a:
            few = sum((int(x) * (0xD1342543DE82EF95 + 2 * j) for j, x in enumerate(h[a:b])), int(b - a)) & (1 << 64) - 1
            yield mix(np.array([few], _U))
        else:
            yield np.zeros(0, _U)
