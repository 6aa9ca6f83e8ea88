"""Words of Arrow string arrays as exact numbers: equal numbers are equal words, within a chunk of texts."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from tallow.llm.wordhash import buffers, chunks

_SAME = np.arange(256, dtype=np.uint8)
_LOWER = _SAME.copy()
_LOWER[65:91] += 32


def _of(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"


class Spans(NamedTuple):
    """Words of texts lo..hi, in order: number, index of the text, whether the word goes on the piece of the word before; the words by number (bytes)."""

    id: np.ndarray
    row: np.ndarray
    joined: np.ndarray
    words: pa.Array
    lo: int
    hi: int


def spans(col: pa.Array, lower: bool = False, breaks: bytes = b"") -> Iterator[Spans]:
    """The words of a string array, chunk by chunk. Words end at SPACES and at the bytes of `breaks`; pieces at the latter and with the text."""
    ends_word, ends_piece, letters = _of(SPACES + breaks), _of(breaks), _LOWER if lower else _SAME
    offsets, data = buffers(col)
    for lo, hi in chunks(offsets):
        at = offsets[lo : hi + 1] - offsets[lo]
        part = letters[data[offsets[lo] : offsets[hi]]]
        n = len(part)
        inside = ~ends_word[part]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        bounds = at[:-1][at[:-1] < n]
        first[bounds] = inside[bounds]
        start = np.flatnonzero(first)
        row = np.searchsorted(at, start, "right") - 1
        # A word has as many letters as there are between its start and the next word's, counted without separators.
        letter = np.flatnonzero(inside)
        edges = np.append(np.searchsorted(letter, start), len(letter)).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(edges), pa.py_buffer(part[inside])])
        coded = words.dictionary_encode()
        joined = np.zeros(len(start), bool)
        if len(start) > 1:
            broken = np.zeros(n + 1, np.int32)
            np.cumsum(ends_piece[part], out=broken[1:])
            joined[1:] = (row[1:] == row[:-1]) & (broken[start[1:]] == broken[start[:-1]])
        yield Spans(coded.indices.to_numpy().astype(np.int64), row + lo, joined, coded.dictionary, lo, hi)
