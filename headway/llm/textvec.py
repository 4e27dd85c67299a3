"""Array views of text batches, shared by the operators of this folder.

Spark hands text to Python as Arrow string arrays, whose buffers already are the UTF-8 bytes of
all rows back to back.  The helpers below work on those bytes with numpy, one bounded chunk of
rows at a time, so that no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 500_000
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Bytes of a word for ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z became a-z.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
ALNUM[65:91] = True  # they are lower-cased on the way
#: Bytes of a word for ``[^\x20\x09-\x0D]+``.
NONSPACE = np.ones(256, dtype=bool)
NONSPACE[9:14] = NONSPACE[32] = False


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit words that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            inverse = pow(_BASE, -1, 1 << 64)
            for name, base in (("up", _BASE), ("down", inverse)):
                steps = np.full(n, base, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self.up, self.down


_powers = _Powers()


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``span_hash`` gets the polynomial hash of any stretch."""
    up, _ = _powers.get(len(values) + 1)
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = _powers.get(len(sums))
    length = (end - start).astype(np.uint64)
    return mix64((sums[end] - sums[start]) * down[start] + length * np.uint64(0xD6E8FEB86659FD93))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows and row offsets (one more than rows); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch holding at most ``limit`` bytes of text, or one row."""
    _, offsets = utf8(batch.column(column))
    at, n = 0, batch.num_rows
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        end = min(max(end, at + 1), n)
        yield batch.slice(at, end - at)
        at = end


class Words:
    """Words of a chunk: byte ``start`` and ``end``, 64-bit ``hash`` and ``row`` bounds.

    Words ``first[r]`` to ``first[r + 1]`` are those of row r.
    """

    def __init__(self, column: pa.Array, kind: np.ndarray = ALNUM) -> None:
        raw, self.offsets = utf8(column)
        self.data = _LOWER[raw]
        n = len(self.data)
        inside = kind[raw]
        edge = np.zeros(n + 1, dtype=bool)
        edge[self.offsets] = True
        before = np.zeros(n, dtype=bool)
        if n:
            before[1:] = inside[:-1]
            before &= ~edge[:n]
        self.start = np.flatnonzero(inside & ~before)
        after = np.zeros(n, dtype=bool)
        if n:
            after[:-1] = inside[1:]
            after &= ~edge[1:]
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        self._hash: np.ndarray | None = None

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            self._hash = span_hash(prefix_sums(self.data), self.start, self.end)
        return self._hash

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every run of n words inside one row."""
        h, total = self.hash, len(self.start)
        if total < n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        out = np.zeros(total - n + 1, dtype=np.uint64)
        for k in range(n):
            out = out * np.uint64(_BASE) + h[k : total - n + 1 + k]
        last = np.repeat(self.first[1:], self.counts()) - n
        at = np.flatnonzero(np.arange(len(out)) <= last[: len(out)])
        return at, mix64(out[at] + np.uint64(n))

    def text(self, first: int, n: int) -> bytes:
        """Words first .. first + n - 1, blank-joined."""
        return b" ".join(self.data[self.start[i] : self.end[i]].tobytes() for i in range(first, first + n))


def member(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Index of each value in a sorted table, or -1."""
    if not len(table):
        return np.full(len(values), -1, dtype=np.int64)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return np.where(table[at] == values, at, -1)


class Sieve:
    """A bit table over 64-bit hashes that lets most absent values go before a search."""

    def __init__(self, table: np.ndarray, bits: int = 20) -> None:
        while len(table) << 3 > 1 << bits and bits < 27:
            bits += 1
        self.shift, self.table = np.uint64(64 - bits), table
        self.seen = np.zeros(1 << bits, dtype=bool)
        self.seen[(table >> self.shift).astype(np.int64)] = True

    def find(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``values`` that are in the table, and where in the table."""
        near = np.flatnonzero(self.seen[(values >> self.shift).astype(np.int64)])
        at = member(values[near], self.table)
        return near[at >= 0], at[at >= 0]


def runs(mask: np.ndarray, edge: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true values; ``edge`` positions begin a new run."""
    m = np.concatenate(([False], mask, [False]))
    begin, stop = m[1:-1] & ~m[:-2], m[1:-1] & ~m[2:]
    if edge is not None and len(mask):
        edge = edge[(edge > 0) & (edge < len(mask))]
        begin[edge] |= mask[edge]
        stop[edge - 1] |= mask[edge - 1]
    return np.flatnonzero(begin), np.flatnonzero(stop) + 1
