"""Postings of token pairs as compressed bitmaps with multiplicity planes.

Documents of a block are numbered from 0.  A pair's posting in a block is one
bitmap of documents for each binary digit of how often they hold the pair: plane
k has the documents whose multiplicity has digit k set.  A plane is kept as the
sorted numbers of its documents or, where that is shorter, as a bitmap.  The
documents of a pair are the union of its planes; its links are the planes'
sizes, each times two to the power of its digit.

A posting is bytes, one plane after the other: the digit (128 added for a
bitmap), the length as a 16-bit number (of documents, or of bytes of the
bitmap), and the plane.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

HEAD = 3


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each size, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def packed(pair: np.ndarray, doc: np.ndarray, times: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pairs, offsets, bytes) of the entries of a block of ``docs`` documents; an entry is a pair's multiplicity in one."""
    order = np.lexsort((doc, pair))
    pair, doc, times = pair[order], doc[order], times[order]
    pairs, of = np.unique(pair, return_inverse=True)
    wide = (docs + 7) // 8
    parts = []
    for k in range(int(times.max()).bit_length() if len(times) else 0):
        own = (times >> k) & 1 > 0
        row, first, n = np.unique(of[own], return_index=True, return_counts=True)
        parts.append((row, np.full(len(row), k), n, first, doc[own]))
    if not parts:
        return pairs, np.zeros(1, np.int64), np.zeros(0, np.uint8)
    base = np.cumsum([0, *[len(p[4]) for p in parts]])
    row, plane, n = (np.concatenate([p[i] for p in parts]) for i in range(3))
    first = np.concatenate([p[3] + b for p, b in zip(parts, base, strict=False)])
    numbers = np.concatenate([p[4] for p in parts])
    order = np.lexsort((plane, row))
    row, plane, n, first = row[order], plane[order], n[order], first[order]
    dense = 2 * n > wide
    size = np.where(dense, wide, 2 * n)
    at = np.cumsum(HEAD + size) - HEAD - size
    out = np.zeros(int((HEAD + size).sum()), np.uint8)
    length = np.where(dense, wide, n)
    out[at], out[at + 1], out[at + 2] = plane + 128 * dense, length & 255, length >> 8
    few = ~dense
    to, ids = _spread(at[few] + HEAD, size[few])[::2], numbers[_spread(first[few], n[few])]
    out[to], out[to + 1] = ids & 255, ids >> 8
    for i in np.flatnonzero(dense):
        bits = np.zeros(8 * wide, np.uint8)
        bits[numbers[first[i] : first[i] + n[i]]] = 1
        out[at[i] + HEAD : at[i] + HEAD + wide] = np.packbits(bits, bitorder="little")
    starts = np.searchsorted(row, np.arange(len(pairs)))
    return pairs, np.append(at[starts], len(out)), out


def planes(offsets: np.ndarray, data: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(posting, digit, documents) of sets of planes: first the sparse ones of all postings together, then each bitmap."""
    at, end, row = offsets[:-1].astype(np.int64), offsets[1:], np.arange(len(offsets) - 1)
    while True:
        open_ = at < end
        at, end, row = at[open_], end[open_], row[open_]
        if not len(at):
            return
        kind, length = data[at], data[at + 1].astype(np.int64) + 256 * data[at + 2].astype(np.int64)
        dense = kind >= 128
        few = ~dense
        to = _spread(at[few] + HEAD, 2 * length[few])[::2]
        if len(to):
            yield np.repeat(row[few], length[few]), np.repeat(kind[few], length[few]).astype(np.int64), data[to].astype(np.int64) + 256 * data[to + 1].astype(np.int64)
        for i in np.flatnonzero(dense):
            ids = np.flatnonzero(np.unpackbits(data[at[i] + HEAD : at[i] + HEAD + length[i]], bitorder="little"))
            yield np.full(len(ids), row[i]), np.full(len(ids), int(kind[i]) - 128), ids
        at = at + HEAD + np.where(dense, length, 2 * length)


def counted(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(documents, links) of each posting: the population of the planes' union, and of the planes by their digits."""
    n = len(offsets) - 1
    links, single, several = np.zeros(n, np.int64), np.zeros(n, np.int64), {}
    at, end, row = offsets[:-1].astype(np.int64), offsets[1:], np.arange(n)
    seen = np.zeros(n, np.int64)
    while True:
        open_ = at < end
        at, end, row = at[open_], end[open_], row[open_]
        if not len(at):
            break
        kind, length = data[at], data[at + 1].astype(np.int64) + 256 * data[at + 2].astype(np.int64)
        dense, digit = kind >= 128, (kind & 127).astype(np.int64)
        size = np.where(dense, length, 2 * length)
        have = length.copy()
        for i in np.flatnonzero(dense):
            have[i] = np.bitwise_count(data[at[i] + HEAD : at[i] + HEAD + length[i]]).sum()
        links[row] += have << digit
        single[row] = have  # right where the posting has one plane
        seen[row] += 1
        at = at + HEAD + size
    for r in np.flatnonzero(seen > 1):
        several[r] = _union(data[offsets[r] : offsets[r + 1]])
    for r, have in several.items():
        single[r] = have
    return single, links


def _union(posting: np.ndarray) -> int:
    """The documents of one posting: its planes merged by OR and counted."""
    merged, at = np.zeros(8192, np.uint8), 0
    while at < len(posting):
        length = int(posting[at + 1]) + 256 * int(posting[at + 2])
        body = at + HEAD
        if posting[at] >= 128:
            merged[:length] |= posting[body : body + length]
            at = body + length
        else:
            ids = posting[body : body + 2 * length : 2].astype(np.int64) + 256 * posting[body + 1 : body + 2 * length : 2].astype(np.int64)
            np.bitwise_or.at(merged, ids >> 3, (1 << (ids & 7)).astype(np.uint8))
            at = body + 2 * length
    return int(np.bitwise_count(merged).sum())
