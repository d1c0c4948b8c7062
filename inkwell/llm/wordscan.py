"""Byte-level word scanning of Arrow string columns with numpy.

Texts of a record batch are handled as one UTF-8 byte buffer, a bounded number of bytes at a time, so the cost is a few
vector passes over the bytes and no Python work per word.  Every word class the operators use is a set of ASCII bytes
(bytes from 0x80 on are always word bytes), hence scanning bytes and scanning code points give the same words.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
"""Texts are scanned this many bytes at a time; a longer text is a chunk of its own."""


def byte_table(separators: bytes, lower: bool) -> np.ndarray:
    """A 256-entry table that maps separators to a space and, if asked, A-Z to a-z."""
    table = np.arange(256, dtype=np.uint8)
    if lower:
        table[65:91] += 32
    table[np.frombuffer(separators, np.uint8)] = 32
    return table


WHITESPACE = bytes([0x20, *range(0x09, 0x0E)])
NON_ALNUM = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
"""Separators after A-Z are lower-cased: all ASCII but digits and letters."""

PLAIN_WORDS = byte_table(WHITESPACE, lower=False)
LOWER_WORDS = byte_table(WHITESPACE, lower=True)


def alnum_table() -> np.ndarray:
    """Lower-case first, then separate: A-Z become letters, all other ASCII but digits and a-z a space."""
    table = np.arange(256, dtype=np.uint8)
    table[np.frombuffer(NON_ALNUM, np.uint8)] = 32
    table[65:91] = np.arange(97, 123)
    return table


ALNUM_WORDS = alnum_table()


class Chunk(NamedTuple):
    """Rows [first, last) of a batch: their bytes end to end and where each row starts."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray


class Words(NamedTuple):
    """Words of a chunk, each followed by one space in ``data``.

    ``starts``/``ends`` are byte positions in ``data``; words ``rows[i]`` to ``rows[i + 1]`` belong to row i, whose bytes are
    ``bytes_[i]`` to ``bytes_[i + 1]`` of ``data`` (with a space at the end if the row has words).
    """

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray
    bytes_: np.ndarray
    source_starts: np.ndarray
    source_ends: np.ndarray


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cut a string column into runs of whole rows of about ``limit`` bytes; null texts count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield Chunk(first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


def edges(chunk: Chunk, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Mapped bytes, word starts, word ends and the index of each row's first word."""
    data = table[chunk.data]
    inside = np.zeros(len(data) + 1, bool)
    np.not_equal(data, 32, out=inside[:-1])
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    closes = inside[:-1] & ~inside[1:]
    cuts = chunk.offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    if len(cuts):  # words never run from one row into the next
        begins[cuts] = inside[cuts]
        closes[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(closes) + 1
    return data, starts, ends, np.searchsorted(starts, chunk.offsets)


def words(chunk: Chunk, table: np.ndarray) -> Words:
    """Words of every row of the chunk, copied into a buffer in which each is followed by one space."""
    data, starts, ends, rows = edges(chunk, table)
    lengths = ends - starts
    to = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths + 1, out=to[1:])
    out = np.full(int(to[-1]) + 40, 32, np.uint8)
    kept = data != 32
    out[np.arange(int(lengths.sum())) + np.repeat(np.arange(len(starts)), lengths)] = data[kept]
    return Words(out, to[:-1], to[1:] - 1, rows, to[rows], starts, ends)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: every input bit affects every output bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    out = np.empty(max(n, 1), np.uint64)
    out[0] = 1
    filled = 1
    while filled < n:
        step = min(filled, n - filled)
        out[filled : filled + step] = out[:step] * np.uint64(pow(base, filled, 1 << 64))
        filled += step
    return out[:n]


POWERS: dict[int, np.ndarray] = {}
"""Powers by base, some 9 MB each, that the hashers of a process share while a task runs."""


class Hasher:
    """Rolling 64-bit hashes of words and of runs of words, from prefix sums modulo 2 ** 64."""

    def __init__(self, seed: int):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.symbols = rng.integers(0, 1 << 64, 256, dtype=np.uint64)
        self.base, self.step = (int(x) | 1 for x in rng.integers(1 << 40, 1 << 62, 2))

    def _powers(self, base: int, n: int) -> np.ndarray:
        if len(POWERS.get(base, ())) < n:
            POWERS[base] = powers(base, max(n, (CHUNK_BYTES + CHUNK_BYTES // 8)))
        return POWERS[base][:n]

    def _runs(self, values: np.ndarray, base: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self._powers(base, len(values)), out=sums[1:])
        inverse = self._powers(pow(base, -1, 1 << 64), len(values) + 1)
        return mix64((sums[ends] - sums[starts]) * inverse[starts])

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return self._runs(self.symbols[data], self.base, starts, ends)

    def grams(self, hashes: np.ndarray, size: int) -> np.ndarray:
        """Hash of each run of ``size`` consecutive word hashes; runs over a row's end are included, callers mask them."""
        n = len(hashes) - size + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        at = np.arange(n)
        return self._runs(hashes, self.step, at, at + size)
