"""Vectorised word hashing over Arrow string arrays.

Words are runs of bytes other than 0x20 and 0x09-0x0D, with A-Z lower-cased.
Each word gets a 64-bit hash: a polynomial over a fixed random byte table,
evaluated for all words of a chunk at once with prefix sums, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 5
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on uint64 arrays."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        base = _BASE if kind == "up" else pow(_BASE, -1, 1 << 64)
        steps = np.full(max(n, CHUNK_BYTES + 1), base & _MASK, np.uint64)
        steps[0] = 1
        _powers[kind] = np.cumprod(steps, dtype=np.uint64)
    return _powers[kind][:n]


class Words(NamedTuple):
    """Words of a chunk of texts, in order: hash, index of the text in the array, byte span in data."""

    hash: np.ndarray
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    data: np.ndarray
    lo: int
    hi: int


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string array; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    _, offs, data = col.buffers()
    if offs is None or len(col) == 0:
        return np.zeros(len(col) + 1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(offs, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    return offsets, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about limit bytes each; a longer text stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def hashes(col: pa.Array) -> np.ndarray:
    """The hash of each entry of a string or binary array, taken as one word."""
    offsets, data = buffers(col)
    at, part = offsets - offsets[0], data[offsets[0] : offsets[-1]]
    sums = np.zeros(len(part) + 1, np.uint64)
    np.cumsum(_BYTE[part] * _power("up", len(part)), out=sums[1:])
    h = (sums[at[1:]] - sums[at[:-1]]) * _power("down", len(part) + 1)[at[:-1]]
    return mix(h + np.diff(at).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def words(col: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Words]:
    """The words of a string array, chunk by chunk of about limit bytes; every row lies in exactly one chunk. A chunk takes some forty times its bytes."""
    offsets, data = buffers(col)
    for lo, hi in chunks(offsets, limit):
        at = offsets[lo : hi + 1] - offsets[lo]
        part = data[offsets[lo] : offsets[hi]]
        n = len(part)
        inside = ~_SPACE[part]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        bounds = at[:-1][at[:-1] < n]
        first[bounds] = inside[bounds]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        ends = at[1:][at[1:] > 0] - 1
        last[ends] = inside[ends]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[part] * _power("up", n), out=sums[1:])
        h = (sums[end] - sums[start]) * _power("down", n + 1)[start]
        h = mix(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        row = np.searchsorted(at, start, "right") - 1 + lo
        yield Words(h, row, start, end, part, lo, hi)
