"""Words of whole Arrow batches as flat numpy arrays.

Texts are UTF-8 bytes side by side, so word borders, hashes and line borders are found for many
texts in a few vector operations. Separators are ASCII bytes, hence cutting bytes is cutting code
points. Work is done on pieces of a batch of about ``PIECE`` bytes (a longer text is a piece of its
own), which bounds memory by the piece and not by the batch. Null texts have no bytes.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from ..shipping import ship_by_value

PIECE = 1 << 20

# Words of `[^\x20\x09-\x0D]+`, and of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z.
BLANK_SEPARATED = np.ones(256, bool)
BLANK_SEPARATED[[0x20, *range(0x09, 0x0E)]] = False
ALPHANUMERIC = np.zeros(256, bool)
ALPHANUMERIC[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_SEED = np.random.Generator(np.random.PCG64(20240131))
BYTE_VALUE = _SEED.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
STEP = np.uint64(0xD6E8FEB86659FD93)


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over all output bits."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def tidy() -> None:
    """Give freed memory back at the end of a task: idle Python workers stay alive beside those of later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


class Hasher:
    """64-bit hashes of byte ranges of a piece; the same bytes hash alike in every task."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if n > len(self.up):
            self.up, self.down = powers(BASE, n), powers(INVERSE, n)

    def sums(self, data: np.ndarray) -> np.ndarray:
        self.grow(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_VALUE[data] * self.up[: len(data)], out=out[1:])
        return out

    def ranges(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((sums[end] - sums[start]) * self.down[start] + (end - start).astype(np.uint64) * STEP)


@dataclass
class Words:
    """Words of the texts of a piece in order. ``first[i]:first[i + 1]`` are those of text ``i``."""

    data: np.ndarray
    text_start: np.ndarray
    text_end: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def texts(self) -> np.ndarray:
        """Number of the text of each word."""
        return np.repeat(np.arange(len(self.text_start)), self.counts)


def pieces(column: pa.Array, most: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, text borders) of successive pieces of a string column; borders start at 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    buffers = column.buffers()
    borders = np.frombuffer(buffers[1], np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if n and buffers[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(borders, borders[row] + most, "right")) - 1)
        end = min(end, n)
        yield row, end, data[borders[row]: borders[end]], borders[row: end + 1] - borders[row]
        row = end


def words_of(data: np.ndarray, borders: np.ndarray, kind: np.ndarray) -> Words:
    """Maximal runs of bytes of ``kind`` that do not cross a text border."""
    inside = kind[data]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    edge = borders[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    opens[edge] = inside[edge]
    closes[edge - 1] = inside[edge - 1]
    start = np.flatnonzero(opens)
    end = np.flatnonzero(closes) + 1
    first = np.searchsorted(start, borders)
    return Words(data, borders[:-1], borders[1:], start, end, first)


def runs_of(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each word the hash of the ``n`` words from it on, and whether its text has so many left."""
    hashes = np.zeros(max(len(words) - n + 1, 0), np.uint64)
    for j in range(n):
        hashes *= STEP
        hashes += words[j: j + len(hashes)]
    hashes = mixed(hashes + np.uint64(n))
    inside = np.ones(len(words), bool)
    for j in range(1, n):
        last = first[1:] - j
        inside[last[last >= first[:-1]]] = False
    return np.concatenate([hashes, np.zeros(len(words) - len(hashes), np.uint64)]), inside


def shingles_of(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words, and the borders of each text's runs.

    A text of fewer words, but not none, has its whole sequence as one run.
    """
    counts = np.diff(first)
    hashes, inside = runs_of(words, first, n)
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        own = np.zeros(len(short), np.uint64)
        for j in range(n - 1):
            has = counts[short] > j
            own[has] = own[has] * STEP + words[first[short[has]] + j]
        hashes[first[short]] = mixed(own + counts[short].astype(np.uint64))
        inside[first[short]] = True
    return hashes[inside], np.concatenate([[0], np.cumsum(inside)])[first]


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur more than once."""
    ordered = np.sort(keys)
    again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(again):
        return np.zeros(len(keys), bool)
    return again[np.minimum(np.searchsorted(again, keys), len(again) - 1)] == keys


def sums_between(values: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Sum of the values between successive borders."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return np.diff(total[borders])


ship_by_value(__name__)
