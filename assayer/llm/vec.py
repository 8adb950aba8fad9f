"""Vectorised reading of Arrow text batches: word boundaries and word hashes of many rows at once."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Rows are taken together up to so many bytes; a longer row is a chunk of its own.
CHUNK_BYTES = 1 << 20


def byte_class(keep: str = "letters") -> np.ndarray:
    """A table that lower-cases A-Z and turns separators into zero."""
    table = np.zeros(256, np.uint8)
    table[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
    table[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
    table[128:] = np.arange(128, 256)
    if keep == "letters and digits":
        table[ord("0") : ord("9") + 1] = np.arange(ord("0"), ord("9") + 1)
    if keep == "all but blanks":
        table[33:65] = np.arange(33, 65)
        table[91:128] = np.arange(91, 128)
        table[14:32] = np.arange(14, 32)
        table[1:9] = np.arange(1, 9)
    return table


@dataclass
class Chunk:
    """Some rows of a batch: from row ``first`` on; ``offsets`` are positions in ``data``."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The rows of a string column in order; nulls count as empty."""
    column = column.fill_null("" if not pa.types.is_binary(column.type) else b"").cast(pa.large_binary())
    n = len(column)
    if not n:
        return
    _, offsets, values = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        to = min(to, n)
        yield Chunk(at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


@dataclass
class Words:
    """Word spans (bytes), the row of each within its chunk, and the mapped bytes."""

    low: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray


def words(chunk: Chunk, table: np.ndarray) -> Words:
    low = np.take(table, chunk.data, mode="clip")  # every byte has its place; this mode is the fastest
    inside = low != 0
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    edges = chunk.offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(low))]
    begins[edges] = inside[edges]
    stops[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return Words(low, starts, ends, parts(starts, chunk.offsets[1:-1]))


def parts(places: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """How many of the sorted ``cuts`` lie at or before each of the sorted ``places``; few cuts are looked up, not many places."""
    return np.repeat(np.arange(len(cuts) + 1), np.diff(np.searchsorted(places, cuts), prepend=0, append=len(places)))


_powers: list[np.ndarray] = []


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        with np.errstate(over="ignore"):
            _powers[:] = [np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)]).cumprod(dtype=np.uint64) for b in (_BASE, _INVERSE)]
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class Hasher:
    """Polynomial hashes of any spans of the mapped bytes, from one running sum."""

    def __init__(self, low: np.ndarray):
        power, self.inverse = _tables(len(low) + 1)
        self.sums = np.zeros(len(low) + 1, np.uint64)
        terms = low.astype(np.uint64)
        terms += np.uint64(1)
        terms *= power[: len(low)]
        np.cumsum(terms, out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.inverse[starts])
