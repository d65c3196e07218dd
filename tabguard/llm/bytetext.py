"""Whole-batch tokenising and hashing of UTF-8 text with numpy.

An Arrow string column is two buffers: all bytes of all rows, and row offsets.
The functions here work on those flat buffers, so that a batch of a thousand
documents costs a handful of array operations and no loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE_VALUES = np.random.RandomState(20240611).randint(1, 1 << 63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def byte_class(chars: str = "", ranges: tuple[tuple[int, int], ...] = (), negate: bool = False) -> np.ndarray:
    """A table of 256 booleans; bytes of non-ASCII characters follow ``negate``."""
    t = np.zeros(256, bool)
    for c in chars:
        t[ord(c)] = True
    for lo, hi in ranges:
        t[lo : hi + 1] = True
    return ~t if negate else t


#: ``[^\x20\x09-\x0D]+``
SPACED = byte_class(ranges=((0x20, 0x20), (0x09, 0x0D)), negate=True)
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` once A-Z are lower-cased
LETTERS = byte_class(ranges=((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)), negate=True)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def uniform(x: np.ndarray) -> np.ndarray:
    """Hashes to doubles in (0, 1)."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * (1.0 / (1 << 53))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n + 1:
        size = max(n + 1, SLICE_BYTES + 1)
        _powers = tuple(np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(size - 1, b, np.uint64))]) for b in (_BASE, _BASE_INVERSE))
    return _powers


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """H with H[i] the hash of the first i bytes; see span_hash."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[data] * _tables(len(data))[0][: len(data)], out=out[1:])
    return out


def span_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte spans [start, end): equal bytes, equal hash."""
    return mix((h[end] - h[start]) * _tables(len(h) - 1)[1][start] + (end - start).astype(np.uint64))


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) for runs of rows of about ``limit`` bytes.

    A single longer row is one slice; null counts as empty.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if len(column) == 0:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, raw = column.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of ``members`` bytes within rows, and each row's range of them (n + 1)."""
    inside = members[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    after[:-1] = inside[1:]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    before[edges] = False
    after[edges[edges > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def lowered_words(data: np.ndarray, offsets: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As words(), after lower-casing A-Z, with each word's hash."""
    low = LOWER[data]
    starts, ends, ranges = words(low, offsets, members)
    return starts, ends, ranges, span_hash(prefix_hash(low), starts, ends)


def shingles(hashes: np.ndarray, ranges: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width`` consecutive words, and each row's range of them.

    A row of fewer words, but not none, has one shingle of all its words.
    """
    n = np.diff(ranges)
    per = np.where(n >= width, n - width + 1, (n > 0).astype(n.dtype))
    out_ranges = np.concatenate([[0], np.cumsum(per)])
    row = np.repeat(np.arange(len(n)), per)
    first = ranges[:-1][row] + (np.arange(out_ranges[-1]) - out_ranges[:-1][row])
    length = np.minimum(n, width)[row]
    acc = length.astype(np.uint64)
    for j in range(width):
        use = length > j
        at = np.minimum(first + j, max(len(hashes) - 1, 0))
        acc = np.where(use, mix(acc * np.uint64(0x9FB21C651E98DF25) + hashes[at]), acc) if len(hashes) else acc
    return acc, out_ranges
