"""Vectorised work on Arrow text columns: word boundaries, word hashes, shingle sets.

Hashes are 64-bit polynomial sums over byte values, mixed afterwards; equal
words have equal hashes and two different ones agree with a chance of about
2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 512 << 10
WIDTH = 5


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit values."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def mixed(*values: int) -> int:
    """The scramble of a few small numbers, as a seed."""
    out = np.zeros(1, np.uint64)
    for v in values:
        out = mix(out + np.uint64(v) + np.uint64(0x9E3779B97F4A7C15))
    return int(out[0])


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
BASE, BACK = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


class Powers:
    """The powers of the base and of its inverse, as many as were asked for; not sent along with functions."""

    def __init__(self):
        self.held = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

    def __reduce__(self):
        return Powers, ()

    def first(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.held[0]) < n:
            for i, base in enumerate((BASE, BACK)):
                steps = np.full(max(n, PIECE_BYTES + 1), base, np.uint64)
                steps[0] = 1
                self.held[i] = np.multiply.accumulate(steps)
        return self.held[0][:n], self.held[1][:n]


POWERS = Powers()


def pieces(column: pa.Array | pa.ChunkedArray, size: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Whole rows of a text column, about ``size`` bytes at a time: first row, end row, bytes, row offsets.  Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_bounds(apart: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in bytes marked as apart or not, and for each row its first word."""
    inside = ~apart
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= apart[:-1]
    ends[:-1] &= apart[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(apart))]
    starts[edge] = inside[edge]
    ends[edge - 1] = inside[edge - 1]
    starts = np.flatnonzero(starts)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of byte spans."""
    up, down = POWERS.first(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words between ASCII white space, A-Z lower-cased, and for each row its first word."""
    low = LOWER[data]
    starts, ends, first = word_bounds(SPACE[low], offsets)
    return span_hashes(low, starts, ends), first


def runs(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of ``width`` consecutive word hashes, from each word on that has as many after it."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, width, np.uint64)
    for i in range(width):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += words[i : i + n]
    return mix(out)


def distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.concatenate(([True], values[1:] != values[:-1]))] if len(values) else values


def shingle_sets(column: pa.Array, width: int = WIDTH) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles; fewer words than ``width`` make one, no words none."""
    for row, end, data, offsets in pieces(column):
        words, first = word_hashes(data, offsets)
        whole = runs(words, width)
        for i in range(end - row):
            a, b = first[i], first[i + 1]
            yield distinct(whole[a : b - width + 1]) if b - a >= width else runs(words[a:b], b - a) if b > a else whole[:0]
