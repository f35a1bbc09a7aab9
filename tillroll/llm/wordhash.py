"""Words of many texts at once, as 64-bit hashes in NumPy arrays.

A word is a maximal run of ASCII digits, ASCII letters (lower-cased) and bytes from 0x80, i.e. of
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing A-Z, read on the UTF-8 bytes.  With other ``letters`` it is a
maximal run of those.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_CHUNK = 1 << 21
_rng = np.random.Generator(np.random.PCG64(20240607))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[65:91] = True
IS_WORD[128:] = True
_EVERY = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)[LOWER]
#: Bytes of words that end at ASCII white space only, ``[^\\x20\\x09-\\x0D]``.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[32, *range(9, 14)]] = False
_ODD = np.uint64(0x9E3779B97F4A7C15)
_POWER = np.cumprod(np.full(256, np.uint64(0xD6E8FEB86659FD93)), dtype=np.uint64)


class Words(NamedTuple):
    """``begin`` and ``end`` are byte offsets in ``data``; ``row`` is the text's number."""

    data: np.ndarray
    offsets: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray

    def bounds(self) -> np.ndarray:
        """For each row, where its words begin; one more at the end."""
        return np.searchsorted(self.row, np.arange(len(self.offsets)))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(29))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the rows' offsets in them; nulls count as empty."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    held = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return held[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(column: pa.Array, letters: np.ndarray = IS_WORD) -> Words:
    data, offsets = utf8(column)
    values = np.where(letters, _EVERY, np.uint64(0))
    begins, ends, hashes = [], [], []
    low = 0
    while low < len(data):
        high = min(len(data), low + _CHUNK)
        while high < len(data) and letters[data[high]]:
            high += 1
        part = data[low:high]
        inside = letters[part]
        edge = np.zeros(len(part) + 1, dtype=bool)
        inner = offsets[(offsets >= low) & (offsets < high)] - low
        edge[inner] = True
        first = inside.copy()
        first[1:] &= ~inside[:-1] | edge[1:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:] | edge[1:-1]
        begin = np.flatnonzero(first)
        if len(begin):
            number = np.cumsum(first, dtype=np.int32) - 1
            place = np.arange(len(part), dtype=np.int32) - begin.astype(np.int32)[np.maximum(number, 0)]
            value = values[part] * _POWER[place & 255]
            hashes.append(mix(np.add.reduceat(value, begin)))
            begins.append(begin + low)
            ends.append(np.flatnonzero(last) + 1 + low)
        low = high
    if not begins:
        none = np.zeros(0, np.int64)
        return Words(data, offsets, none, none, none, np.zeros(0, np.uint64))
    begin = np.concatenate(begins)
    row = np.searchsorted(offsets, begin, side="right") - 1
    return Words(data, offsets, begin, np.concatenate(ends), row, np.concatenate(hashes))


def shingles(found: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the first words of all runs of ``k`` words inside one text, and the runs' hashes."""
    n = len(found.hash) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total = total * _ODD + found.hash[j : j + n]
    at = np.flatnonzero(found.row[:n] == found.row[k - 1 :])
    return at, mix(total[at])


def one_run(hashes: np.ndarray) -> int:
    """The hash of one run of words, as :func:`shingles` has it."""
    total = np.zeros(1, np.uint64)
    for h in hashes:
        total = total * _ODD + h
    return int(mix(total)[0])
