"""Words of a text column as numpy arrays, straight from the column's UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1_000_000
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads them evenly."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def spaced() -> np.ndarray:
    """Bytes of words divided by white space: all but the space and tab to carriage return."""
    inside = np.ones(256, bool)
    inside[[0x20, *range(0x09, 0x0E)]] = False
    return inside


def alphanumeric() -> np.ndarray:
    """Bytes of words of ASCII letters and digits and of all other characters beyond ASCII."""
    inside = np.zeros(256, bool)
    inside[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
    return inside


def ascii_lowered() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 0x20
    return table


@dataclass
class Words:
    """Words of consecutive texts: byte places in ``data`` and each text's first word."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # one more than texts

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        at = self.starts[0]
        longest = int((self.ends - self.starts).max())
        length = np.diff(self.starts, append=self.ends[-1])
        place = np.arange(self.ends[-1] - at) - np.repeat(self.starts - at, length)
        # bytes between words lie beyond their word's end and weigh nothing
        inside = place < np.repeat(self.ends - self.starts, length)
        power = np.ones(longest + 1, np.uint64)
        power[1:] = _STEP
        power = np.multiply.accumulate(power)
        worth = _BYTE_WORTH[self.data[at:self.ends[-1]]]
        worth *= power[np.minimum(place, longest)]
        worth[~inside] = 0
        return mixed(np.add.reduceat(worth, self.starts - at))

    def text(self, i: int, j: int) -> bytes:
        """Words i to j (exclusive) joined by one space."""
        data = self.data
        return b" ".join(data[self.starts[k]:self.ends[k]].tobytes() for k in range(i, j))


_BYTE_WORTH = mixed(np.arange(1, 257, dtype=np.uint64) * _STEP)


def word_slices(column: pa.Array, inside: np.ndarray, lower: bool,
                most: int = SLICE_BYTES) -> Iterator[tuple[int, Words]]:
    """Words of a column without nulls, in runs of whole texts of about ``most`` bytes."""
    column = column.cast(pa.large_binary())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, 8 * column.offset)
    everything = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    table = ascii_lowered()
    row = 0
    while row < n:
        stop = int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1
        stop = min(n, max(stop, row + 1))
        data = everything[offsets[row]:offsets[stop]]
        data = table[data] if lower else data
        bounds = offsets[row:stop + 1] - offsets[row]
        yield row, find_words(data, bounds, inside)
        row = stop


def find_words(data: np.ndarray, bounds: np.ndarray, inside: np.ndarray) -> Words:
    """Words of texts that lie one behind the other, at ``bounds``."""
    word = inside[data]
    begins, closes = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    closes[:-1] &= ~word[1:]
    edges = bounds[:-1][np.diff(bounds) > 0]  # first byte of each text that has any
    begins[edges] = word[edges]
    before = edges[edges > 0] - 1
    closes[before] = word[before]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(closes) + 1
    return Words(data, starts, ends, np.searchsorted(starts, bounds))
