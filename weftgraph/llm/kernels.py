"""Vectorised text kernels over Arrow string buffers.

A batch is cut into chunks of about half a megabyte (at least one whole text each), so the
temporaries stay in cache whatever the length of a batch. Words are maximal runs of word
bytes; their 64-bit hash is a polynomial over random byte values, taken from prefix sums.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19
_ROOT = np.uint64(0x9E3779B97F4A7C15)
_ROOT_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(maxsize=4)
def _byte_values(lower: bool) -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    if lower:
        values[65:91] = values[97:123]
    return values


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 2 * CHUNK_BYTES)
        for i, root in enumerate((_ROOT, _ROOT_INV)):
            table = np.full(size, root, np.uint64)
            table[0] = 1
            _powers[i] = np.multiply.accumulate(table)
    return _powers[0], _powers[1]


def space_mask() -> np.ndarray:
    """Word bytes of ``[^\\x20\\x09-\\x0D]+``."""
    word = np.ones(256, bool)
    word[9:14] = word[32] = False
    return word


def alnum_mask() -> np.ndarray:
    """Word bytes of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` once A-Z are lower-cased."""
    word = np.ones(256, bool)
    word[0:128] = False
    word[48:58] = word[97:123] = word[65:91] = True
    return word


class Words:
    """Words of a chunk of texts: ``hashes``; ``bounds[i]:bounds[i+1]`` are those of text i, ``starts``
    and ``ends`` their bytes in ``data``, of which text i has ``text_offsets[i]:text_offsets[i+1]``."""

    __slots__ = ("hashes", "bounds", "starts", "ends", "data", "first", "text_offsets")

    def __init__(self, hashes, bounds, starts, ends, data, first, text_offsets):
        self.hashes, self.bounds, self.starts, self.ends, self.data, self.first, self.text_offsets = hashes, bounds, starts, ends, data, first, text_offsets


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string column, nulls as empty texts."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)), offs


def chunks(column: pa.Array, word: np.ndarray, lower: bool = True) -> Iterator[Words]:
    """``Words`` of consecutive texts of ``column``; ``first`` is the index of the first text."""
    data, offs = text_buffers(column)
    n, i = len(column), 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + CHUNK_BYTES, "right")) - 1)
        yield _words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], word, lower, i)
        i = j


def _words(data: np.ndarray, offs: np.ndarray, word: np.ndarray, lower: bool, first: int) -> Words:
    size = len(data)
    inside = word[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edge = offs[:-1][offs[:-1] < size]
    begins[edge] = inside[edge]
    stops = np.zeros(size + 1, bool)
    stops[1:] = inside
    stops[:-1] &= ~inside
    cut = offs[1:][offs[1:] > 0]
    stops[cut] = inside[cut - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops)
    up, down = _power_tables(size + 1)
    sums = np.zeros(size + 1, np.uint64)
    np.cumsum(_byte_values(lower)[data] * up[:size], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))
    return Words(hashes, np.searchsorted(starts, offs), starts, ends, data, first, offs)


def shingle_hashes(words: np.ndarray, k: int = 4) -> np.ndarray:
    """Hashes of the k-word shingles of one text; of the whole sequence if it is shorter."""
    n = len(words)
    if n == 0:
        return words
    if n < k:
        total = np.array([n], np.uint64)
        for i in range(n):
            total = total * _STEP[0] + words[i : i + 1] * _STEP[i % 4]
        return mix(total)
    out = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        out = out * _STEP[0] + words[i : n - k + 1 + i] * _STEP[i % 4]
    return mix(out)
