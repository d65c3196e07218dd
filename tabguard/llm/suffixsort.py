"""Sorted, front-coded runs of suffixes and a loser tree that merges them.

A run lists suffixes in order; each but the first is stored as the length of the
prefix that it shares with the one before and its other bytes.  The loser tree
keeps, for every run, how much of its head agrees with the last suffix put out.
Of two heads the one that agrees in more bytes comes first, and only where both
agree in equally many are bytes compared, from there on.  The merge so knows the
common prefix of all neighbours without another look at the bytes.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np


def encode_run(rows: np.ndarray, parts: tuple[tuple[np.ndarray, str], ...], rest: list[bytes]) -> bytes:
    """Sorted rows of bytes as one front-coded run, with columns of numbers (array, type) and a piece of bytes for each."""
    n, width = rows.shape
    shared = np.zeros(n, np.uint8)
    if n > 1:
        differ = rows[1:] != rows[:-1]
        shared[1:] = np.where(differ.any(1), differ.argmax(1), width)
    tails = rows[np.arange(width)[None, :] >= shared[:, None]]
    sizes = np.array([len(x) for x in rest], np.uint8)
    return b"".join([struct.pack("<ii", n, width), *[a.astype(t).tobytes() for a, t in parts], sizes.tobytes(), shared.tobytes(), tails.tobytes(), *rest])


class Run:
    """Reads a run; ``head`` is the next suffix, ``shared`` its prefix in common with the one before."""

    def __init__(self, blob: bytes, types: tuple[str, ...]):
        self.n, self.width = struct.unpack_from("<ii", blob)
        at, self.columns = 8, []
        for t in types:
            self.columns.append(np.frombuffer(blob, t, self.n, at).tolist())
            at += np.dtype(t).itemsize * self.n
        sizes = np.frombuffer(blob, np.uint8, self.n, at).astype(np.int64)
        self.common = np.frombuffer(blob, np.uint8, self.n, at + self.n).tolist()
        self.blob, self.at, self.nth = blob, at + 2 * self.n, -1
        ends = len(blob) - sizes.sum() + np.cumsum(sizes)
        self.rest = list(zip((ends - sizes).tolist(), ends.tolist(), strict=True))
        self.head: bytes | None = b""
        self.shared = 0
        self.advance()

    def advance(self) -> None:
        self.nth += 1
        if self.nth >= self.n:
            self.head = None
            return
        self.shared = self.common[self.nth]
        end = self.at + self.width - self.shared
        self.head = self.head[: self.shared] + self.blob[self.at : end]
        self.at = end

    def entry(self) -> tuple:
        """(suffix, further bytes, the columns' numbers)."""
        a, b = self.rest[self.nth]
        return self.head, self.blob[a:b], *[c[self.nth] for c in self.columns]


def _agree(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which ``known`` bytes need no look."""
    x = int.from_bytes(a[known:], "big") ^ int.from_bytes(b[known:], "big")
    return len(a) - (x.bit_length() + 7) // 8


def merge(runs: list[Run]) -> Iterator[tuple[int, tuple]]:
    """(prefix shared with the entry before, entry) over all runs in order."""
    if not runs:
        return
    k = 1
    while k < len(runs):
        k *= 2
    shared = [0] * k
    heads: list[Run | None] = [*runs, *[None] * (k - len(runs))]
    loser = [0] * k

    def first(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); where bytes were compared the loser's prefix is that shared with the winner."""
        x, y = heads[a], heads[b]
        if y is None or y.head is None:
            return a, b
        if x is None or x.head is None:
            return b, a
        if shared[a] != shared[b]:
            return (a, b) if shared[a] > shared[b] else (b, a)
        both = _agree(x.head, y.head, shared[a])
        win, lose = (a, b) if both >= x.width or x.head[both] < y.head[both] else (b, a)
        shared[lose] = both
        return win, lose

    winner = [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        winner[node], loser[node] = first(winner[2 * node], winner[2 * node + 1])
    top = winner[1]
    if k == 1:
        top = 0
    before = 0
    while heads[top] is not None and heads[top].head is not None:
        run = heads[top]
        yield before, run.entry()
        run.advance()
        shared[top] = run.shared
        node = (top + k) // 2
        while node:
            top, loser[node] = first(top, loser[node])
            node //= 2
        before = shared[top]
