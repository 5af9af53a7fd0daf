"""Words of Arrow string arrays as numpy arrays: positions, rows and 64-bit hashes.

A word is a maximal run of ASCII letters and digits and of bytes of any other
character, with A-Z lower-cased. Texts are taken in chunks of a quarter of a megabyte,
so memory does not grow with the batch; a longer text is a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 18
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD1342543DE82EF95)  # odd, so it has an inverse modulo 2**64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the one of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _byte_classes() -> np.ndarray:
    """0 for separators, else the lower-cased byte."""
    table = np.zeros(256, np.uint8)
    for low, high in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
        table[low : high + 1] = np.arange(low, high + 1)
    table[0x41:0x5B] = np.arange(0x61, 0x7B)
    return table


_CLASS = _byte_classes()
_VALUE = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _MULTIPLIER)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(name: str, step: int, n: int) -> np.ndarray:
    if len(_powers[name]) < n:
        steps = np.full(max(n, CHUNK_BYTES + 1), step, np.uint64)
        steps[0] = 1
        _powers[name] = np.cumprod(steps)
    return _powers[name]


class Chunk(NamedTuple):
    """Rows ``low`` to ``high`` of an array: their bytes, and where each begins."""

    low: int
    high: int
    data: np.ndarray
    offsets: np.ndarray


class Words(NamedTuple):
    """``first[r]`` to ``first[r + 1]`` are the words of row r of the chunk."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The array in pieces of about ``limit`` bytes; NULL counts as empty."""
    if not len(texts):
        return
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    places = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)
    places = places[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    low = 0
    while low < len(texts):
        high = int(np.searchsorted(places, places[low] + limit, "right")) - 1
        high = min(max(high, low + 1), len(texts))
        yield Chunk(low, high, data[places[low] : places[high]], places[low : high + 1] - places[low])
        low = high


def words(chunk: Chunk) -> Words:
    letters = _CLASS[chunk.data]
    n = len(letters)
    inside = letters != 0
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    rows = chunk.offsets[(chunk.offsets > 0) & (chunk.offsets < n)]
    begins[rows] = inside[rows]
    ends[rows - 1] = inside[rows - 1]
    start = np.flatnonzero(begins)
    end = np.flatnonzero(ends) + 1
    up = _power("up", int(_STEP), n + 1)
    down = _power("down", pow(int(_STEP), -1, 1 << 64), n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUE[letters] * up[:n], out=sums[1:])
    hashed = mix((sums[end] - sums[start]) * down[start])
    return Words(start, end, hashed, np.searchsorted(start, chunk.offsets))


def prefix_hashes(chunk: Chunk, start: np.ndarray, length: int) -> np.ndarray:
    """Hashes of ``length`` bytes from each start on, lower-cased; those of words as long are the same."""
    hashed = np.zeros(len(start), np.uint64)
    power = np.uint64(1)
    for k in range(length):
        hashed += _VALUE[_CLASS[chunk.data[start + k]]] * power
        power = np.uint64(int(power) * int(_STEP) & 0xFFFFFFFFFFFFFFFF)
    return mix(hashed)


def shingles(found: Words, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """``(row, hash)`` of each run of ``width`` words.

    A row with fewer words, but not none, has all of them as its one shingle.
    """
    hashes, first, row = found.hash, found.first, found.row
    counts = np.diff(first)
    whole = max(len(hashes) - width + 1, 0)
    rolled = np.zeros(whole, np.uint64)
    for k in range(width):
        rolled = rolled * _MULTIPLIER + hashes[k : k + whole]
    fits = row[:whole] == row[width - 1 : width - 1 + whole]
    rows, values = row[:whole][fits], mix(rolled[fits])
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        single = np.empty(len(short), np.uint64)
        for i, r in enumerate(short):
            value = int(counts[r])
            for word in hashes[first[r] : first[r + 1]].tolist():
                value = (value * int(_MULTIPLIER) + word) & 0xFFFFFFFFFFFFFFFF
            single[i] = value
        rows = np.concatenate([rows, short])
        values = np.concatenate([values, mix(single)])
        order = np.argsort(rows, kind="stable")
        rows, values = rows[order], values[order]
    return rows, values
