"""Words of Arrow text columns as NumPy arrays; used inside Arrow map tasks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once in a task; a single longer text is still handled whole.
CHUNK = 1 << 20

SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_cache: dict[str, np.ndarray] = {}


def _grown(name: str, base: np.uint64, n: int) -> np.ndarray:
    if name not in _cache or len(_cache[name]) < n:
        _cache[name] = _powers(base, max(n, CHUNK + 1))
    return _cache[name][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of about limit bytes each; every row falls in one."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive slices of a text column."""
    data, offsets = buffers(column)
    for a, b in slices(offsets, limit):
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


@dataclass
class Words:
    """Words of several texts: where each starts and ends in data, and which text it is of."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    rows: int

    def firsts(self) -> np.ndarray:
        """Index of each text's first word, and the number of words last."""
        return np.searchsorted(self.row, np.arange(self.rows + 1))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        out = np.zeros(len(self.start), np.uint64)
        at = 0
        while at < len(out):  # some MB of bytes at a time: the sums take eight bytes for each
            low = int(self.start[at])
            upto = max(at + 1, int(np.searchsorted(self.end, low + CHUNK, "right")))
            start, end = self.start[at:upto] - low, self.end[at:upto] - low
            n = int(end[-1])
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(_BYTE[self.data[low : low + n]] * _grown("up", _BASE, n), out=total[1:])
            out[at:upto] = mix((total[end] - total[start]) * _grown("down", _BASE_INVERSE, n)[start] + (end - start).astype(np.uint64))
            at = upto
        return out


def spans(data: np.ndarray, offsets: np.ndarray, lower: bool = False, breaks: np.ndarray = SPACES) -> Words:
    """The runs of bytes outside breaks, of every text, where they stand in data."""
    rows, n = len(offsets) - 1, len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint8), none, none, none, rows)
    if lower:
        data = ASCII_LOWER[data]
    solid = ~breaks[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:] = True, ~solid[:-1]
    after[-1], after[:-1] = True, ~solid[1:]
    start = np.flatnonzero(solid & (before | edge[:-1]))
    end = np.flatnonzero(solid & (after | edge[1:])) + 1
    row = np.repeat(np.arange(rows), np.diff(np.searchsorted(start, offsets)))
    return Words(data, start, end, row, rows)


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False, breaks: np.ndarray = SPACES) -> Words:
    """The same, with data made anew of the words alone, one space apart."""
    w = spans(data, offsets, lower, breaks)
    length = w.end - w.start + 1
    to = np.zeros(len(w.start) + 1, np.int64)
    np.cumsum(length, out=to[1:])
    out = np.append(w.data, np.uint8(32))[np.arange(to[-1]) + np.repeat(w.start - to[:-1], length)]
    out[to[1:] - 1] = 32
    return Words(out, to[:-1], to[1:] - 1, w.row, w.rows)
