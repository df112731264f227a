"""Vectorised text kernels: whole Arrow batches become numpy arrays of words and 64-bit word hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
ROWS = 1 << 16  # a row's number in a part has 16 bits in the keys of multisets
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 2**64)
_POW: dict[int, np.ndarray] = {}

#: Bytes that separate words: ASCII white space only, as in SQL's [ \t\n\v\f\r].
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
#: Everything in ASCII that is neither a letter nor a digit; bytes from 0x80 belong to words.
NON_WORD = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    got = _POW.get(base)
    if got is None or len(got) < n:
        size = max(n, 1 << 16)
        got = np.full(size, base, U64)
        got[0] = 1
        _POW[base] = got = np.multiply.accumulate(got)
    return got[:n]


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, most: int = 1_500_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about `most` bytes of text and at most ROWS rows, one row at least: memory stays bounded, no text is cut."""
    n = batch.num_rows
    if not n:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    at = 0
    while at < n:
        base = ends[at - 1] if at else 0
        to = min(max(at + 1, int(np.searchsorted(ends, base + most, "right"))), at + ROWS)
        yield batch.slice(at, to - at)
        at = to


class Words:
    """Words of a batch of texts. `doc`: the row of each word; `start`, `end`: its bytes; `hash`: 64 bits."""

    def __init__(self, column: pa.Array, separators: np.ndarray = SPACES, lower: bool = False):
        if lower:
            column = pc.utf8_lower(column)
        self.data, self.offsets = raw(column)
        self.rows = len(self.offsets) - 1
        n = len(self.data)
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = ~separators[self.data]
        first = np.zeros(n + 1, bool)
        first[self.offsets] = True
        at = inside[1:-1]
        self.start = np.flatnonzero(at & (~inside[:-2] | first[:n]))
        self.end = np.flatnonzero(at & (~inside[2:] | first[1:])) + 1
        self.bounds = np.searchsorted(self.start, self.offsets)  # first word of each row, and the end
        self.count = np.diff(self.bounds)
        self.doc = np.repeat(np.arange(self.rows), self.count)
        sums = np.zeros(n + 1, U64)
        np.cumsum(_BYTE[self.data] * _powers(_BASE, n), out=sums[1:])
        self.hash = mix((sums[self.end] - sums[self.start]) * _powers(_INV, n + 1)[self.start] + (self.end - self.start).astype(U64))

    def without_digits(self) -> Words:
        """The words that hold no digit: numbers, keys and names with numbers aren't language."""
        digits = np.concatenate([[0], np.cumsum((self.data >= 48) & (self.data <= 57))])
        use = digits[self.end] == digits[self.start]
        self.start, self.end, self.doc, self.hash = self.start[use], self.end[use], self.doc[use], self.hash[use]
        self.bounds = np.searchsorted(self.start, self.offsets)
        self.count = np.diff(self.bounds)
        return self

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the n words from each position on, and whether they lie in one text."""
        w, total = self.hash, len(self.hash)
        out = np.zeros(total, U64)
        if total < n:
            return out, np.zeros(total, bool)
        part = np.zeros(total - n + 1, U64)
        for j in range(n):
            part = part * U64(_BASE) + w[j : total - n + 1 + j]
        out[: total - n + 1] = mix(part)
        ok = np.arange(total) + n <= self.bounds[1:][self.doc]
        return out, ok


def slide(x: np.ndarray, width: int, what: np.ufunc, fill: int) -> np.ndarray:
    """Minimum or maximum of x[i : i + width] for each i, with `fill` beyond the end."""
    n = len(x)
    out = np.concatenate([x, np.full(width, fill, x.dtype)])
    size = 1
    while size * 2 <= width:
        out = what(out[:-size], out[size:]) if size else out
        size *= 2
    if width > size:
        rest = width - size
        out = what(out[:-rest], out[rest:])
    return out[:n]
