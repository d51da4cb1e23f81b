"""Arrow text batches as numpy arrays: bytes, words, characters, lines and their hashes.

Texts come in slices of about a megabyte, so the memory of a task does not grow with the batch; a
longer text is a slice of its own. Nulls count as empty texts. All separators used here are ASCII,
so UTF-8 can be taken apart by bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_P = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_INVERSE = tuple(np.uint64(pow(int(p), -1, 1 << 64)) for p in _P)
_BYTE = tuple(np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for seed in (11, 12))
_powers: dict[tuple[int, bool], np.ndarray] = {}


def _class(keep) -> np.ndarray:
    return np.array([bool(keep(b)) for b in range(256)])


#: Bytes of words that white space parts, and of words of letters, digits and all beyond ASCII.
NOT_SPACE = _class(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
ALNUM = _class(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)


def powers(which: int, inverse: bool, n: int) -> np.ndarray:
    """The first ``n`` powers of a multiplier, or of its inverse, modulo 2**64."""
    known = _powers.get((which, inverse))
    if known is None or len(known) < n:
        base = np.full(max(n, SLICE_BYTES + 1), (_INVERSE if inverse else _P)[which], dtype=np.uint64)
        base[0] = 1
        np.cumprod(base, out=base)
        if len(base) > 4 * SLICE_BYTES:  # not kept for a single very long text
            return base[:n]
        known = _powers[which, inverse] = base
    return known[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


@dataclass
class Slice:
    """Rows ``first`` to ``first + rows`` of a batch: their bytes, and where each begins."""

    first: int
    rows: int
    data: np.ndarray
    offsets: np.ndarray

    def row_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, positions, side="right") - 1

    def lower(self) -> Slice:
        return Slice(self.first, self.rows, LOWER[self.data], self.offsets)


@dataclass
class Spans:
    """Pieces of a slice: the row of each, its first byte and the byte after its last."""

    row: np.ndarray
    start: np.ndarray
    end: np.ndarray


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut a text column into slices of at most ``limit`` bytes, or one row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        last = min(last, n)
        lo, hi = offsets[first], offsets[last]
        yield Slice(first, last - first, data[lo:hi], offsets[first : last + 1] - lo)
        first = last


def words(s: Slice, member: np.ndarray) -> Spans:
    """Maximal runs of member bytes; none crosses rows."""
    n = len(s.data)
    if not n:
        empty = np.zeros(0, np.int64)
        return Spans(empty, empty, empty)
    inside = member[s.data]
    edge = np.zeros(n + 1, bool)
    edge[s.offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:n]
    start = np.flatnonzero(starts)
    return Spans(s.row_of(start), start, np.flatnonzero(ends) + 1)


def lines(s: Slice) -> Spans:
    """Pieces between line feeds; every row has one at least, the empty row an empty one."""
    feeds = np.flatnonzero(s.data == 10)
    start = np.concatenate([s.offsets[:-1], feeds + 1])
    row = np.concatenate([np.arange(s.rows), s.row_of(feeds)])
    order = np.lexsort((start, row))
    row, start = row[order], start[order]
    end = np.empty_like(start)
    end[:-1] = start[1:] - 1
    last = np.ones(len(row), bool)
    last[:-1] = row[1:] != row[:-1]
    end[last] = s.offsets[row[last] + 1]
    return Spans(row, start, end)


def prefix_hash(data: np.ndarray, which: int) -> np.ndarray:
    """Running sums from which ``span_hash`` takes the hash of any span."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[which][data] * powers(which, False, len(data) + 1)[:-1], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
    """64-bit hashes of spans; equal bytes hash alike wherever they stand."""
    return mix((prefix[end] - prefix[start]) * powers(which, True, len(prefix))[start])


def hashes(data: np.ndarray, spans: Spans, which: int = 0) -> np.ndarray:
    return span_hash(prefix_hash(data, which), spans.start, spans.end, which)


def grams(h: np.ndarray, row: np.ndarray, k: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``k`` consecutive items, and the place of the first item of each; none crosses rows."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * _P[which] + h[i : i + n]
    at = np.flatnonzero(row[:n] == row[k - 1 :])
    return mix(out[at]), at


def counts_by_row(row: np.ndarray, rows: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(row, weights=weights, minlength=rows)[:rows].astype(np.int64)
