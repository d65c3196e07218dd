"""A linear-chain conditional random field over hashed token features, in numpy.

Sequences come as one flat run of tokens.  A token has a few feature numbers of
its own and those of its neighbours; each (feature, offset) has a table of
weights by label.  Sequences are decoded and trained in batches of like length,
all of a batch one step at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WIDTH = 4_096
OFFSETS = (-3, -2, -1, 0, 1, 2, 3)
#: tokens, with padding, of the sequences that are decoded together
TOGETHER = 32_768
NEVER = -1e4


def batches(lengths: np.ndarray, together: int = TOGETHER, shuffled: np.random.RandomState | None = None) -> Iterator[np.ndarray]:
    """Sequence numbers of like length, so many that padded they are ``together`` tokens at most; a longer one is alone."""
    order, parts, lo = np.argsort(lengths, kind="stable"), [], 0
    while lo < len(order):
        hi = lo + 1
        while hi < len(order) and (hi - lo + 1) * lengths[order[hi]] <= together:
            hi += 1
        parts.append(order[lo:hi])
        lo = hi
    for i in shuffled.permutation(len(parts)) if shuffled is not None else range(len(parts)):
        yield parts[i]


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


class Field:
    """``features`` numbers per token are looked at with all offsets, ``single`` more at the token alone."""

    def __init__(self, labels: int, allowed: np.ndarray, features: int, single: int):
        self.labels, self.features, self.tables = labels, features, features * len(OFFSETS) + single
        self.weight = np.zeros((self.tables, WIDTH, labels), np.float32)
        self.step = np.where(allowed, 0.0, NEVER).astype(np.float32)
        self.allowed = allowed
        self.start = np.where(allowed[0], 0.0, NEVER).astype(np.float32)  # as behind label 0

    def _ids(self, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """(tokens, tables) of indexes into the tables; 0 stands beyond a sequence's ends."""
        n = len(x)
        of = np.repeat(np.arange(len(starts)), np.diff(starts, append=n))
        out = np.zeros((n, self.tables), np.int64)
        for j, d in enumerate(OFFSETS):
            at = np.arange(n) + d
            inside = (at >= 0) & (at < n)
            inside[inside] = of[at[inside]] == of[inside.nonzero()[0]]
            own = np.zeros((n, self.features), np.int64)
            own[inside] = x[at[inside], : self.features]
            out[:, j * self.features : (j + 1) * self.features] = own
        out[:, len(OFFSETS) * self.features :] = x[:, self.features :]
        return out

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        out = np.zeros((len(ids), self.labels), np.float32)
        for t in range(self.tables):
            out += self.weight[t, ids[:, t]]
        return out

    def _padded(self, e: np.ndarray, starts: np.ndarray, lengths: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = lengths[own]
        inside = np.arange(n.max()) < n[:, None]
        at = np.where(inside, starts[own][:, None] + np.arange(n.max()), 0)
        return e[at], inside, at

    def _marginals(self, e: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(probability of each label at each step, expected numbers of each transition, of each first label)."""
        n, steps, k = e.shape
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[:, 0] = self.start + e[:, 0]
        for t in range(1, steps):
            now = _lse(alpha[:, t - 1, :, None] + self.step, 1) + e[:, t]
            alpha[:, t] = np.where(inside[:, t, None], now, alpha[:, t - 1])
        for t in range(steps - 2, -1, -1):
            back = _lse(self.step + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[:, t] = np.where(inside[:, t + 1, None], back, 0)
        whole = _lse(alpha[:, -1], 1)
        p = np.exp(alpha + beta - whole[:, None, None]) * inside[:, :, None]
        moves = np.zeros((k, k))
        for t in range(1, steps):
            own = inside[:, t]
            if own.any():
                moves += np.exp(alpha[own, t - 1, :, None] + self.step + (e[own, t] + beta[own, t])[:, None, :] - whole[own, None, None]).sum(0)
        return p, moves, p[:, 0].sum(0)

    def train(self, x: np.ndarray, starts: np.ndarray, y: np.ndarray, epochs: int = 6, rate: float = 0.2, decay: float = 1e-5, seed: int = 5) -> None:
        """Maximum likelihood by adaptive gradient steps."""
        r, lengths, ids = np.random.RandomState(seed), np.diff(starts, append=len(x)), self._ids(x, starts)
        params = [self.weight, self.step, self.start]
        seen = [np.full(p.shape, 1e-4, np.float32) for p in params]
        for _ in range(epochs):
            for own in batches(lengths, 2_048, r):
                e, inside, at = self._padded(self.emissions(ids_own := ids[np.concatenate([np.arange(starts[i], starts[i] + lengths[i]) for i in own])]), np.concatenate([[0], np.cumsum(lengths[own])[:-1]]), lengths[own], np.arange(len(own)))
                p, moves, first = self._marginals(e, inside)
                truth = np.concatenate([y[starts[i] : starts[i] + lengths[i]] for i in own])
                delta = p[inside]
                delta[np.arange(len(truth)), truth] -= 1
                for t in range(self.tables):
                    used, where = np.unique(ids_own[:, t], return_inverse=True)
                    g = np.zeros((len(used), self.labels), np.float32)
                    np.add.at(g, where, delta)
                    g = g / len(own) + decay * self.weight[t, used]
                    seen[0][t, used] += g * g
                    self.weight[t, used] -= rate * g / np.sqrt(seen[0][t, used])
                firsts = np.concatenate([[0], np.cumsum(lengths[own])[:-1]])
                real, began = np.zeros_like(moves), np.bincount(truth[firsts], minlength=self.labels)
                follow = np.ones(len(truth), bool)
                follow[firsts] = False
                np.add.at(real, (truth[np.flatnonzero(follow) - 1], truth[follow]), 1)
                for i, (g, legal) in enumerate((((moves - real) / len(own), self.allowed), ((first - began) / len(own), self.allowed[0])), 1):
                    g = np.where(legal, g, 0).astype(np.float32)
                    seen[i] += g * g
                    params[i] -= rate * g / np.sqrt(seen[i])

    def decode(self, x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the most likely labels of each sequence as a whole, by Viterbi; the probability of each of them)."""
        labels, sure = np.zeros(len(x), np.int64), np.zeros(len(x))
        lengths = np.diff(starts, append=len(x))
        for own in batches(lengths):
            flat = np.concatenate([np.arange(starts[i], starts[i] + lengths[i]) for i in own])
            firsts = np.concatenate([[0], np.cumsum(lengths[own])[:-1]])
            e, inside, _ = self._padded(self.emissions(self._ids(x[flat], firsts)), firsts, lengths[own], np.arange(len(own)))
            steps = e.shape[1]
            best, back = self.start + e[:, 0], np.zeros(e.shape, np.int8)
            for t in range(1, steps):
                way = best[:, :, None] + self.step
                back[:, t] = way.argmax(1)
                now = way.max(1) + e[:, t]
                best = np.where(inside[:, t, None], now, best)
            out = np.zeros(inside.shape, np.int64)
            at = best.argmax(1)
            for t in range(steps - 1, -1, -1):
                out[:, t] = at
                if t:
                    at = np.where(inside[:, t], np.take_along_axis(back[:, t], at[:, None], 1)[:, 0], at)
            p, *_ = self._marginals(e, inside)
            labels[flat], sure[flat] = out[inside], np.take_along_axis(p, out[:, :, None], 2)[:, :, 0][inside]
        return labels, sure
