"""Words, lines and rolling hashes of whole Arrow string columns, in numpy.

A word is a maximal run of bytes other than space and 0x09-0x0D, the pattern
``[^\\x20\\x09-\\x0D]+``; those bytes are ASCII, so UTF-8 text can be cut at byte level.
A column is worked on in chunks of whole rows of about ``CHUNK`` bytes, which bounds the
temporary arrays whatever the batch size is; one very long text is a chunk of its own.
Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
U64 = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: every input bit reaches every output bit."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_STEP = 0xD1342543DE82EF95
_BACK = pow(_STEP, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def _power(n: int) -> list[np.ndarray]:
    """Powers of the step and of its inverse modulo 2**64, for n positions at least."""
    if len(_powers[0]) < n:
        size = 1 << max(20, (n - 1).bit_length())
        for i, base in enumerate((_STEP, _BACK)):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers


@dataclass
class Words:
    """Words of the rows ``first`` to ``first + len(bounds) - 1`` of a column.

    ``start`` and ``end`` are byte offsets in ``data``; the words of row ``first + i``
    are ``bounds[i]`` to ``bounds[i + 1]`` of them, its bytes ``offsets[i]`` to ``offsets[i + 1]``.
    """

    first: int
    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    bounds: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.bounds) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def owner(self) -> np.ndarray:
        """Row (from 0) of each word."""
        return np.repeat(np.arange(self.rows), self.counts())

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word; ``lower`` treats A-Z as a-z."""
        return span_hashes(self.data, self.start, self.end, lower)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hashes of the byte ranges [start, end) by one prefix sum over the data."""
    if not len(start):
        return np.zeros(0, U64)
    up, down = _power(len(data) + 1)
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum((_LOWER if lower else _BYTE)[data] * up[: len(data)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U64))


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null rows become empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def chunks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets from 0) of successive runs of whole rows."""
    data, offsets = raw(column)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, "right")) - 1)
        yield i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


#: Separators of terms: all of ASCII but letters and digits.
TERMS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def words(column: pa.Array, space: np.ndarray = _SPACE) -> Iterator[Words]:
    """The words of a column by chunks; ``space`` says which bytes separate them."""
    for first, data, offsets in chunks(column):
        full = ~space[data]
        edge = np.zeros(len(data) + 1, bool)  # a row begins here
        edge[offsets] = True
        before = np.empty(len(data), bool)
        before[:1] = True
        before[1:] = ~full[:-1]
        start = np.flatnonzero(full & (before | edge[:-1]))
        after = np.empty(len(data), bool)
        after[-1:] = True
        after[:-1] = ~full[1:]
        end = np.flatnonzero(full & (after | edge[1:])) + 1
        yield Words(first, data, offsets, start, end, np.searchsorted(start, offsets))


def windows(hashes: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` successive words within a row, and the row bounds among them.

    Window j of row i begins at word ``bounds[i] + j`` of the input.
    """
    n = np.maximum(np.diff(bounds) - size + 1, 0)
    new = np.concatenate([[0], np.cumsum(n)])
    at = np.arange(new[-1]) + np.repeat(bounds[:-1] - new[:-1], n)
    return combined(hashes, at, range(size)), new


def combined(hashes: np.ndarray, at: np.ndarray, places) -> np.ndarray:
    """For each position, one hash of the words at the given places after it, in order."""
    total = np.zeros(len(at), U64)
    for place in places:
        total += hashes[at + place] * U64((_STEP * (2 * place + 3) ** 5 | 1) & (2**64 - 1))
    return mix(total)
