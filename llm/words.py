"""Words of whole Arrow string columns and their hashes, as numpy arrays.

A word is a longest run of bytes other than space and tab..carriage return
(``[^\\x20\\x09-\\x0D]+`` over UTF-8, where those bytes never occur inside a
character). Texts go through in chunks of about ``CHUNK`` bytes, at least one
text each, so that the arrays stay small; a text is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 500_000

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: ASCII but letters and digits
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

_BASE = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over the whole word (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class _Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown when needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            for name, base in (("up", self.base), ("down", self.inverse)):
                steps = np.full(n, base, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self.up[:n], self.down[:n]


_POWERS = tuple(_Powers(b) for b in _BASE)


class Runs:
    """Hashes of runs values[start:end]; equal runs have equal hashes wherever they stand."""

    def __init__(self, values: np.ndarray, which: int = 0):
        up, self.down = _POWERS[which].get(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * up[: len(values)], out=self.sums[1:])

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    return Runs(values, which).hash(starts, ends)


@dataclass
class Words:
    """Words of some texts in reading order.

    first/last: row range of the chunk in its column. row: each word's text,
    counted from ``first``. start/end: bytes in ``data``. hash: of its bytes.
    begin: first word of each text, with the number of words at the end.
    """

    first: int
    last: int
    data: np.ndarray
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    begin: np.ndarray

    def windows(self, size: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """First words of all windows of ``size`` words within one text, and their hashes."""
        at = np.arange(max(len(self.row) - size + 1, 0))
        at = at[self.row[at] == self.row[at + size - 1]]
        return at, run_hashes(self.hash, at, at + size, which)


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column (null: empty) and the offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_string()).fill_null("")
    _, where, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes, one row at least."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last


def words(column: pa.Array | pa.ChunkedArray, lower: bool = False, size: int = CHUNK, breaks: np.ndarray = _SPACE) -> Iterator[Words]:
    """The words of every text; ``lower`` folds A-Z only; ``breaks``: which bytes stand between words."""
    whole, all_offsets = text_bytes(column)
    for first, last in chunks(all_offsets, size):
        offsets = all_offsets[first : last + 1] - all_offsets[first]
        data = whole[all_offsets[first] : all_offsets[last]]
        if lower:
            data = _LOWER[data]
        inside = ~breaks[data]
        opens, closes = inside.copy(), inside.copy()
        opens[1:] &= ~inside[:-1]
        closes[:-1] &= ~inside[1:]
        edge = offsets[1:-1]
        edge = edge[(edge > 0) & (edge < len(data))]
        opens[edge] = inside[edge]
        closes[edge - 1] = inside[edge - 1]
        start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        begin = np.searchsorted(start, offsets)
        row = np.repeat(np.arange(last - first), np.diff(begin))
        hashes = run_hashes(data.astype(np.uint64) + np.uint64(1), start, end)
        yield Words(first, last, data, row, start, end, hashes, begin)
