"""Whole texts as byte arrays: words, hashes and n-grams of a batch without a Python object per word.

A word is a maximal run of bytes other than space and 0x09-0x0D, which in UTF-8 is the pattern ``[^\\x20\\x09-\\x0D]+``.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes of text taken at once, so that the arrays of a slice stay in the processor's cache.
SLICE_BYTES = 1 << 18

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: neighbouring inputs get unrelated outputs."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_VALUE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
PRIME = np.uint64(0x100000001B3)


def slices(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first row, bytes, offsets)`` of consecutive rows of a text column, null counting as empty.

    A slice holds whole texts: as many as fit in SLICE_BYTES, at least one.
    """
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    row = 0
    for chunk in chunks:
        chunk = pc.fill_null(chunk.cast(pa.large_string()), "")
        if len(chunk) == 0:
            continue
        _, ends, data = chunk.buffers()
        offsets = np.frombuffer(ends, np.int64)[chunk.offset:chunk.offset + len(chunk) + 1]
        raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        first = 0
        while first < len(chunk):
            last = int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, "right")) - 1
            last = min(max(last, first + 1), len(chunk))
            part = offsets[first:last + 1]
            yield row + first, raw[part[0]:part[-1]], part - part[0]
            first = last
        row += len(chunk)


@dataclass
class Words:
    """Words of a slice: byte ``starts`` and ``ends``, and ``per_text``, where the words of each text begin."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    per_text: np.ndarray

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word: a polynomial in mixed byte values, mixed once more."""
        if len(self.starts) == 0:
            return np.zeros(0, np.uint64)
        lengths = self.ends - self.starts
        powers = np.cumprod(np.full(int(lengths.max()), PRIME, np.uint64), dtype=np.uint64)
        place = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        letters = self.data[np.repeat(self.starts, lengths) + place]
        sums = np.add.reduceat(BYTE_VALUE[letters] * powers[place], np.cumsum(lengths) - lengths, dtype=np.uint64)
        return _mix(sums + lengths.astype(np.uint64))

    def text_of(self) -> np.ndarray:
        """The number of the text that each word is in."""
        return np.repeat(np.arange(len(self.per_text) - 1), np.diff(self.per_text))


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Words of the texts ``data[offsets[i]:offsets[i + 1]]``; a word never runs across texts."""
    solid = ~IS_SPACE[data]
    begins, stops = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    stops[:-1] &= ~solid[1:]
    borders = offsets[1:-1]
    borders = borders[(borders > 0) & (borders < len(data))]
    begins[borders] |= solid[borders]
    stops[borders - 1] |= solid[borders - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets))


def combine(*parts: np.ndarray | int) -> np.ndarray:
    """One 64-bit hash of several hashes in order."""
    out = np.zeros(1, np.uint64)
    for part in parts:
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + np.asarray(part, dtype=np.uint64))
    return out


def previous(values: np.ndarray, per_text: np.ndarray, steps: int, fill: int = 0) -> np.ndarray:
    """The value ``steps`` places earlier in the same text, ``fill`` before its beginning."""
    out = np.full(len(values), fill, values.dtype)
    if len(values) > steps:
        out[steps:] = values[:-steps]
    for k in range(steps):
        at = per_text[:-1] + k
        out[at[at < per_text[1:]]] = fill
    return out


def sum_per_text(values: np.ndarray, per_text: np.ndarray) -> np.ndarray:
    """Sums of the values of each text, zero for a text without any; each text is summed on its own."""
    out = np.zeros(len(per_text) - 1, np.float64)
    full = np.flatnonzero(np.diff(per_text) > 0)
    if len(full):
        out[full] = np.add.reduceat(values.astype(np.float64), per_text[:-1][full])
    return out
