"""Words of whole Arrow batches as numpy arrays: one pass over the UTF-8 bytes, no Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)

#: Lower case of ASCII letters; other bytes stay.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of words: ASCII letters and digits, and all bytes of other scripts.
_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[97:123] = True
_WORD[128:] = True


_known: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers; those of up to two million are kept."""
    if base not in _known or n > len(_known[base]):
        out = np.full(n, base, dtype=U64)
        out[:1] = 1
        np.cumprod(out, dtype=U64, out=out)
        if n > 1 << 21:
            return out
        _known[base] = out
    return _known[base][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes every output bit."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


def slices(batches: Iterator[pa.RecordBatch], column: str, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The rows again, in slices of about ``size`` bytes of text; a longer text comes alone and whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        length = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(length) // size
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column, and where each row begins (one more entry at the end); a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def folded(data: np.ndarray) -> np.ndarray:
    """Lower case: ASCII and the accented capitals of Latin-1 (two bytes, the first 0xC3)."""
    low = _LOWER[data]
    if len(data) > 1:
        capital = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        low[1:][capital] += 32
    return low


class Words:
    """Words of the rows of one text column.

    A word is a longest run of ASCII letters, digits and non-ASCII characters; case is folded. ``hash`` has 64
    mixed bits of each word; ``start`` and ``end`` are byte positions in ``data``; row ``i`` has the words
    ``first[i]`` to ``first[i + 1]``.
    """

    def __init__(self, column: pa.Array):
        self.data, self.offsets = flat(column)
        self.low = low = folded(self.data)
        n = len(low)
        inside = _WORD[low] if n else np.zeros(0, bool)
        begins = np.zeros(n + 1, bool)
        begins[self.offsets[:-1]] = True
        edge = np.empty(n + 1, bool)
        edge[0], edge[n], edge[1:n] = True, True, inside[1:] != inside[:-1]
        edge |= begins
        at = np.flatnonzero(edge)
        here, there = at[:-1], at[1:]
        keep = inside[here] if n else np.zeros(0, bool)
        self.start, self.end = here[keep], there[keep]
        self.first = np.searchsorted(self.start, self.offsets)
        term = (low.astype(U64) + U64(1)) * _powers(_BASE, n)
        total = np.zeros(n + 1, U64)
        np.cumsum(term, out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * _powers(_INVERSE, n + 1)[self.start])

    @property
    def row(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.first))


def ngrams(word: np.ndarray, n: int) -> np.ndarray:
    """Rolling hash of each ``n`` words in turn: entry ``i`` covers words ``i`` to ``i + n - 1``."""
    m = max(0, len(word) - n + 1)
    out = np.zeros(m, U64)
    for j in range(n):
        out *= U64(_BASE)
        out += word[j : j + m]
    return mix(out)


def longs(a: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit numbers with the same bits as Spark's long."""
    return a.view(np.int64)


def ragged(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column from all values and the length of each row."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
