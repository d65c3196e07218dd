"""Operator 2: secrets by rules, and a character convolutional network beside them.

The rules find assignments, access keys and hexadecimal runs.  Every other run
of sixteen or more token characters is a candidate, and of twelve or more if it
holds a digit or one of ``+ / _ =``; the network reads it with the characters around
it, a run longer than ``INSIDE`` in all windows of that length, of which the
largest probability counts.  It is trained on labelled findings of the same
corpus: candidates that a rule calls an assignment or access key against those
that no rule calls a secret, all distinct windows of both.  They are dealt over shards of ``SHARD``
windows; shards train at once, from weights that one of them has begun, and their weights
are averaged, ``ROUNDS`` times.  What announces a secret to a rule must not decide here: each training
window appears with its surroundings blanked, and with those of another window.
Candidates outside the rules may be secrets too, so a first network, which sees
no surroundings, takes those out of the clean sample that look to it as most
known secrets do.  Half as many windows again hold runs that are no secrets: network
addresses, dates, numbers, names, and words in capitals.  Scores are calibrated on a part of the sample that was not
trained on, all of whose windows are counted by their logits in steps of 1 / ``STEP``, and the
threshold is the highest step that keeps ``RECALL`` of its secrets.

One pass reads the texts and writes spans and candidate windows; training,
scoring and redaction read those.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabguard.llm.shared import saved, table, unused

KINDS = ("assign", "access", "hex", "model")
# fixed values: the rules
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST = (12, 18, 16)

CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=.-])(?:[A-Za-z0-9+/_=.-]{16,}|(?=[A-Za-z]*[0-9+/_=.-])[A-Za-z0-9+/_=.-]{12,15})")
BEFORE, INSIDE, AFTER = 24, 64, 12
WINDOW = BEFORE + INSIDE + AFTER
#: windows of a shard, of a rare kind those that each shard gets at least if there are so many, and the smallest share of a kind in training
SHARD, SHOWN, SHARE = 16_384, 512, 0.2
ROUNDS = 2
#: steps of a logit that are told apart, and of a weight when weights are averaged
STEP, FINE = 64, 1 << 24
RECALL = 0.98
FILTERS = 24
#: passes over the sample, and the steps that are taken at least, however few labels there are
EPOCHS, STEPS = 6, 300
#: a character's class is its code below 96 (printable ASCII), 1 beyond; 0 is nothing
ALPHABET = 97


def rule_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all rule matches, by start, then kind."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST[0]]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST[1]]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    out.sort()
    return out


def candidates(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, str, int]]:
    """(start, end, window, label): 1 where a rule sees an assigned or access key, 2 for other hex with letters, 0 else.

    The window is WINDOW characters, and more by what the run has beyond INSIDE.
    """
    out = []
    for m in CANDIDATE.finditer(text):
        run, start, end = m.group(), m.start(), m.end()
        own = [k for a, k, b in spans if a < end and b > start]
        # runs of digits, dots and separators alone are numbers, not findings
        label = 1 if any(k < 2 for k in own) else 2 if own and not run.isdigit() else 0
        window = text[max(0, start - BEFORE) : start].rjust(BEFORE, "\0") + run.ljust(INSIDE, "\0") + text[end : end + AFTER].ljust(AFTER, "\0")
        out.append((start, end, window, label))
    return out


SPANS = "array<struct<start:int,kind:int,end:int>>"
CANDIDATES = "array<struct<start:int,end:int,window:binary,part:binary,label:int>>"
_BASE = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
_CAND = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("window", pa.binary()), ("part", pa.binary()), ("label", pa.int32())]))


def _classes(window: str) -> bytes:
    return bytes(0 if c == "\0" else ord(c) - 30 if " " <= c <= "~" else 1 for c in window)


def _part(window: bytes, start: int, spans: list[tuple[int, int, int]]) -> bytes | None:
    """Of a run in several windows the one to learn from: at the rule's match, or else at a place dealt by hash."""
    more = len(window) - WINDOW
    if not more:
        return None
    at = next((max(0, a - start) for a, _, b in spans if a < start + INSIDE + more and b > start), zlib.crc32(window) % (more + 1))
    at = min(at, more)
    return window[at : at + WINDOW]


def _find(batches: Iterator[pa.RecordBatch], text: str, keep: list[str], base_name: str, cand_name: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        base, cand = [], []
        for value in batch.column(text):
            value = value.as_py() or ""
            spans = rule_spans(value)
            base.append([{"start": a, "kind": k, "end": b} for a, k, b in spans])
            read = [(a, b, _classes(w), y) for a, b, w, y in candidates(value, spans)]
            cand.append([{"start": a, "end": b, "window": w, "part": _part(w, a, spans), "label": y} for a, b, w, y in read])
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(base, _BASE), pa.array(cand, _CAND)], [*keep, base_name, cand_name])


def searched(docs: DataFrame, keep: list[str]) -> tuple[DataFrame, str, str]:
    """The kept columns, with the rules' spans and all candidates of each text; and the names of these two columns."""
    base, cand = unused(docs, "base"), unused(docs, "candidates")
    added = [T.StructField(base, T.DataType.fromDDL(SPANS)), T.StructField(cand, T.DataType.fromDDL(CANDIDATES))]
    schema = T.StructType([docs.schema[c] for c in keep] + added)
    return saved(docs.mapInArrow(lambda it: _find(it, "text", keep, base, cand), schema), "secret-candidates"), base, cand


class Network:
    """Two convolutions over characters, the largest response of each filter, a logistic output."""

    def __init__(self, seed: int = 3):
        r = np.random.RandomState(seed)
        init = lambda *s: (r.randn(*s) * np.sqrt(2.0 / s[0])).astype(np.float32)
        self.embed = (r.randn(ALPHABET, 8) * 0.5).astype(np.float32)
        self.w = [self.embed, init(5 * 9, FILTERS), np.zeros(FILTERS, np.float32), init(5 * FILTERS, FILTERS), np.zeros(FILTERS, np.float32), init(FILTERS, 1), np.zeros(1, np.float32)]
        self.scale, self.shift, self.least = 1.0, 0.0, 2.0
        inside = np.zeros((WINDOW, 1), np.float32)
        inside[BEFORE : BEFORE + INSIDE] = 1
        self.inside = inside

    @staticmethod
    def _columns(x: np.ndarray) -> np.ndarray:
        return np.lib.stride_tricks.sliding_window_view(x, 5, axis=1).transpose(0, 1, 3, 2).reshape(x.shape[0], x.shape[1] - 4, -1)

    @staticmethod
    def _back(g: np.ndarray, length: int) -> np.ndarray:
        n, m, wide = g.shape
        g = g.reshape(n, m, 5, wide // 5)
        out = np.zeros((n, length, wide // 5), np.float32)
        for j in range(5):
            out[:, j : j + m] += g[:, :, j]
        return out

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        e, w1, b1, w2, b2, w3, b3 = self.w
        z = np.concatenate([e[x], np.broadcast_to(self.inside, (len(x), WINDOW, 1))], axis=2)
        c1 = self._columns(z)
        h1 = np.maximum(c1 @ w1 + b1, 0)
        c2 = self._columns(h1)
        h2 = np.maximum(c2 @ w2 + b2, 0)
        at = h2.argmax(1)
        top = np.take_along_axis(h2, at[:, None], 1)[:, 0]
        return (top @ w3 + b3)[:, 0], (x, c1, h1, c2, at, top)

    def train(self, x: np.ndarray, y: np.ndarray, steps: int = STEPS, seed: int = 4, epochs: int = EPOCHS) -> None:
        r, step = np.random.RandomState(seed), 0
        m, v = [np.zeros_like(p) for p in self.w], [np.zeros_like(p) for p in self.w]
        for _ in range(max(epochs, -(-steps * 128 // max(1, len(x))))):
            order = r.permutation(len(x))
            for lo in range(0, len(x), 128):
                own = order[lo : lo + 128]
                grads = self._grads(x[own], y[own])
                step += 1
                for i, g in enumerate(grads):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    self.w[i] -= (0.003 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)

    def _grads(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        e, w1, _, w2, _, w3, _ = self.w
        logit, (x, c1, h1, c2, at, top) = self.forward(x)
        d = ((1 / (1 + np.exp(-logit)) - y) / len(x)).astype(np.float32)[:, None]
        dtop = (d @ w3.T) * (top > 0)
        g2 = np.zeros((len(x), c2.shape[1], FILTERS), np.float32)
        np.put_along_axis(g2, at[:, None], dtop[:, None], 1)
        g1 = self._back(g2 @ w2.T, h1.shape[1]) * (h1 > 0)
        gz = self._back(g1 @ w1.T, WINDOW)[:, :, :8]
        ge = np.zeros_like(e)
        np.add.at(ge, x.ravel(), gz.reshape(-1, 8))
        flat = lambda c: c.reshape(-1, c.shape[-1])
        return [ge, flat(c1).T @ flat(g1), g1.sum((0, 1)), flat(c2).T @ flat(g2), g2.sum((0, 1)), top.T @ d, d.sum(0)]

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self.forward(x[i : i + 256])[0] for i in range(0, len(x), 256)]) if len(x) else np.zeros(0)

    def calibrate(self, x: np.ndarray, y: np.ndarray, recall: float, weight: np.ndarray | None = None) -> None:
        """A logistic fit of the score, and the threshold that keeps ``recall`` of the positives, with the precision that it costs."""
        self.fit(self.logits(x), y, recall, np.ones(len(y)) if weight is None else weight)

    def fit(self, z: np.ndarray, y: np.ndarray, recall: float, weight: np.ndarray, counts: np.ndarray | None = None) -> None:
        """The same from logits, of which each stands for ``counts`` windows."""
        counts = np.ones(len(y), np.int64) if counts is None else counts
        weight = weight * len(y) / weight.sum()
        a, b = 1.0, 0.0
        for _ in range(200):
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
            a = max(a - 0.05 * ((weight * (p - y) * z).mean() + 0.001 * a), 0.01)  # a higher logit is never less likely
            b -= 0.05 * (weight * (p - y)).mean()
        self.scale, self.shift = a, b
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        own = np.flatnonzero(y == 1)[np.argsort(p[y == 1], kind="stable")]
        upto = np.cumsum(counts[own])
        self.least = float(p[own[np.searchsorted(upto, int((1 - recall) * upto[-1]), side="right")]])
        self.recall, self.precision = float(counts[own][p[own] >= self.least].sum() / upto[-1]), float((weight * y)[p >= self.least].sum() / weight[p >= self.least].sum())

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(x) + self.shift, -30, 30)))

    def largest(self, windows: list[bytes]) -> np.ndarray:
        """Each run's largest probability over all its windows."""
        out = np.zeros(len(windows))
        single = np.array([i for i, w in enumerate(windows) if len(w) == WINDOW], int)
        if len(single):
            out[single] = self.probability(np.frombuffer(b"".join(windows[i] for i in single), np.uint8).reshape(-1, WINDOW).astype(np.int64))
        for i, w in enumerate(windows):
            if len(w) > WINDOW:
                view = np.lib.stride_tricks.sliding_window_view(np.frombuffer(w, np.uint8), WINDOW)
                out[i] = max(self.probability(np.unique(view[lo : lo + 4_096], axis=0).astype(np.int64)).max() for lo in range(0, len(view), 4_096))
        return out


def _blank(x: np.ndarray) -> np.ndarray:
    out = x.copy()
    out[:, :BEFORE] = 0
    out[:, BEFORE + INSIDE :] = 0
    return out


def _swapped(x: np.ndarray) -> np.ndarray:
    """Each run in the surroundings of another."""
    out, other = x.copy(), x[np.random.RandomState(len(x)).permutation(len(x))]
    out[:, :BEFORE], out[:, BEFORE + INSIDE :] = other[:, :BEFORE], other[:, BEFORE + INSIDE :]
    return out


def _decoys(no: np.ndarray, n: int, seed: int = 8) -> np.ndarray:
    """Windows of runs that are no secrets, in the surroundings of clean ones: addresses, dates, numbers, names, and words in other cases."""
    r = np.random.RandomState(seed)
    d = lambda lo, hi: int(r.randint(lo, hi))
    word = lambda lo, hi: "".join("abcdefghijklmnopqrstuvwxyz"[i] for i in r.randint(0, 26, d(lo, hi)))
    said = [bytes(w[BEFORE : BEFORE + INSIDE]) for w in no]
    words = [w for w in ("".join(chr(c + 30) for c in b if c) for b in said) if w.strip(".-_/").isalpha()]
    plain = lambda lo, hi: words[d(0, len(words))] if words and r.rand() < 0.7 else word(lo, hi)
    kinds = (
        lambda: ".".join(str(d(1, 256)) for _ in range(4)),
        lambda: ".".join(str(d(1, 256)) for _ in range(4)) + r.choice([".", "-", "/24", ""]),
        lambda: f"{d(1900, 2100)}-{d(1, 13):02}-{d(1, 29):02}T{d(0, 24):02}",
        lambda: f"{d(1, 29):02}.{d(1, 13):02}.{d(1900, 2100)}.{d(0, 99)}",
        lambda: f"{d(1, 999)}-{d(100, 999)}-{d(1000, 9999)}-{d(10, 99)}",
        lambda: f"{d(1, 999)}.{d(0, 10**9)}",
        lambda: f"{d(1, 99)}.{d(100, 999)}.{d(100, 999)}.{d(100, 999)}",
        lambda: plain(12, 20).upper(),
        lambda: plain(11, 19).upper() + ".",
        lambda: plain(12, 20).title(),
        lambda: plain(12, 20).lower() + r.choice(["", "."]),
        lambda: f"{word(3, 9)}-{word(3, 9)}-{word(3, 9)}",
        lambda: f"{word(3, 9)}_{word(3, 9)}_{word(2, 9)}",
        lambda: f"www.{word(4, 12)}.{word(2, 4)}/{word(3, 9)}",
        lambda: f"/{word(3, 6)}/{word(3, 9)}/{word(3, 9)}.{word(2, 4)}",
        lambda: f"{word(3, 9)}/{word(3, 9)}/{word(3, 9)}",
        lambda: f"{word(5, 12)}.{word(5, 12)}.{word(2, 6)}",
        lambda: r.choice(["=", "-", ".", "_"]) * d(12, 40),
    )
    out = no[r.randint(0, len(no), n)].copy()
    for w in out:
        run = kinds[d(0, len(kinds))]()[:INSIDE]
        w[BEFORE : BEFORE + INSIDE] = np.frombuffer(_classes(run.ljust(INSIDE, "\0")), np.uint8)
    return out


def _windows(windows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(windows), np.uint8).reshape(-1, WINDOW).astype(np.int64)


def _examples(shard: pa.Table, first: Network | None, cut: float) -> tuple[np.ndarray, np.ndarray]:
    """All windows of a shard and half as many decoys as it has clean ones, without those clean ones that ``first`` takes for secrets."""
    rows = sorted(zip(shard.column("window").to_pylist(), shard.column("y").to_pylist(), strict=True))
    x, y = _windows([w for w, _ in rows]), np.array([v for _, v in rows], float)
    no = x[y == 0]
    if len(no) > 1:
        x, y = np.concatenate([x, _decoys(no, len(no) // 2, 8 + shard.column("shard")[0].as_py())]), np.concatenate([y, np.zeros(len(no) // 2)])
    if first is not None:
        clean = y > 0
        clean[~clean] = first.logits(_blank(x[~clean])) < cut
        if (y[clean] == 0).any():
            x, y = x[clean], y[clean]
    return x, y


def _even(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rarer kind is repeated, whole, until it is ``SHARE`` of all."""
    few = y == (y.mean() < 0.5)
    times = int(SHARE / (1 - SHARE) * (~few).sum() / max(1, few.sum())) if few.any() else 0
    return np.concatenate([x, *[x[few]] * (times - 1)]), np.concatenate([y, *[y[few]] * (times - 1)])


def _learnt(shard: pa.Table, net: Network, first: Network | None, cut: float, blank: bool, alone: bool, turn: int) -> pa.Table:
    """The weights after a shard's windows, and their number.

    A shard that is alone goes on until it has taken enough steps; of others
    each window is seen blanked in one round and in other surroundings in the next.
    """
    x, y = _examples(shard, first, cut)
    n = len(x)
    x, y = _even(x, y)
    odd = (np.arange(len(x)) + turn) % 2 == 0
    if blank:
        x = _blank(x)
    elif turn < 0:
        x, y = np.concatenate([_blank(x), _swapped(x)]), np.concatenate([y, y])
    else:
        x = np.where(odd[:, None], _blank(x), _swapped(x))
    net.train(x, y, steps=0 if blank or not alone else STEPS, seed=4 + turn, epochs=max(1, min(EPOCHS, 2 * SHARD // len(x))) if alone else 1)
    return pa.table({"weights": pa.array([np.concatenate([w.ravel() for w in net.w]).astype(np.float32)], pa.list_(pa.float32())), "n": pa.array([n], pa.int64())})


def _trained(shards: DataFrame, n: int, first: Network | None = None, cut: float = 0.0) -> Network:
    """A network that has learnt from all shards: one begins, then all go on from its weights and are averaged; the first network sees no surroundings."""
    net = Network()
    for turn in range(-1, 0 if n == 1 else ROUNDS if first else 1):
        own = shards.where("shard = 0") if turn < 0 else shards
        one = net  # what this round begins with
        learnt = own.groupBy("shard").applyInArrow(lambda t: _learnt(t, one, first, cut, first is None, n == 1, turn), "weights array<float>, n long")  # noqa: B023
        # whole numbers, whose sum is the same in any order
        parts = learnt.select("n", F.posexplode("weights").alias("place", "w")).groupBy("place").agg(F.sum((F.col("w").cast("double") * FINE).cast("long") * F.col("n")).alias("w"), F.sum("n").alias("n"))
        flat = np.array([r["w"] / r["n"] / FINE for r in parts.orderBy("place").collect()], np.float32)  # a row a weight
        net = Network()
        net.w = [w.reshape(like.shape) for w, like in zip(np.split(flat, np.cumsum([v.size for v in net.w])[:-1]), net.w, strict=True)]
    return net


def _stepped(z: np.ndarray, y: np.ndarray) -> pa.Table:
    """How many windows of each kind have a logit in each step."""
    steps, n = np.unique(np.stack([np.floor(z * STEP).astype(np.int64), y.astype(np.int64)]), axis=1, return_counts=True)
    return pa.table({"step": steps[0], "y": steps[1], "n": n.astype(np.int64)})


def _counted(shards: DataFrame, logits) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logits of all windows by step, ascending, their kind, and how many there are: as many rows as there are steps."""
    steps = shards.groupBy("shard").applyInArrow(lambda t: _stepped(*logits(t)), "step long, y long, n long").groupBy("step", "y").agg(F.sum("n").alias("n")).orderBy("step", "y").collect()
    return np.array([r["step"] / STEP for r in steps]), np.array([float(r["y"]) for r in steps]), np.array([r["n"] for r in steps], np.int64)


def _dealt(windows: DataFrame, n: int, share: dict[int, int], more: bool = True) -> DataFrame:
    """Every window in one of ``n`` shards; with ``more``, of a kind with few in a shard in as many as give each ``SHOWN``, or all there are."""
    times = {y: min(n, -(-n * SHOWN // max(1, share.get(y, 0)))) if more else 1 for y in (0, 1)}
    at, k = F.xxhash64("window", F.lit("shard")), F.when(F.col("y") == 1, times[1]).otherwise(times[0])
    shard = F.explode(F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.pmod(F.pmod(at, F.lit(n)) + i, F.lit(n)).cast("int")))
    return windows.select("window", "y", shard.alias("shard")).repartition(n, "shard")


def fitted(found: DataFrame, cand: str = "candidates", recall: float = RECALL) -> Network | None:
    """The network, or none where the corpus has too few labelled findings of a kind.

    All distinct windows are learnt from, but for a fifth by hash, all of which
    are counted to calibrate the scores and to say which clean windows look to
    the first network as secrets do that it has not seen.  The fifth is the one whose
    labelled windows are nearest that share, or, if none has both kinds in and
    beside it, everything.
    """
    flat = found.select(F.explode(cand).alias("c")).select(F.coalesce("c.part", "c.window").alias("window"), (F.col("c.label") > 0).cast("int").alias("y"))
    flat = saved(flat.distinct().withColumn("fold", F.pmod(F.xxhash64("window"), F.lit(5))), "secret-windows")
    sizes = {(r["y"], r["fold"]): r["n"] for r in flat.groupBy("y", "fold").agg(F.count("*").alias("n")).collect()}  # ten rows
    share = {y: sum(n for (v, _), n in sizes.items() if v == y) for y in (0, 1)}
    if min(share.values()) < 8:
        return None
    whole = [k for k in range(5) if all(0 < sizes.get((y, k), 0) < share[y] for y in (0, 1))]
    fold = min(whole, key=lambda k: abs(5 * sizes[1, k] - share[1]), default=None)
    n = -(-sum(share.values()) // SHARD)
    own, other = (flat, flat) if fold is None else (flat.where(F.col("fold") != fold), flat.where(F.col("fold") == fold))
    shards = _dealt(own, n, share)
    first = _trained(shards, n)
    seen = lambda t: (first.logits(_blank(_windows(t.column("window").to_pylist()))), np.ones(len(t)))
    z, _, counts = _counted(_dealt(other.where("y = 1"), n, share, False), seen)
    cut = float(z[np.searchsorted(np.cumsum(counts), (1 - recall) * counts.sum(), side="right")])
    net = _trained(shards, n, first, cut)

    def judged(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        x, y = _examples(t, first, cut)
        return net.logits(np.concatenate([_blank(x), _swapped(x)])), np.concatenate([y, y])

    z, y, counts = _counted(_dealt(other, n if fold is None else -(-n // 5), share, False), judged)
    net.fit(z, y, recall, counts.astype(float), counts)
    return net


def _spans(batch: pa.RecordBatch, base_name: str, cand_name: str, net: Network | None) -> list[list[dict]]:
    """The spans of each row, those of the network among them, in order."""
    base, cand = batch.column(base_name).to_pylist(), batch.column(cand_name).to_pylist()
    open_ = [(i, c) for i, own in enumerate(cand) for c in own if net and not any(b["start"] < c["end"] and b["end"] > c["start"] for b in base[i])]
    if open_:
        for (i, c), p in zip(open_, net.largest([c["window"] for _, c in open_]), strict=True):
            if p >= net.least:
                base[i].append({"start": c["start"], "kind": 3, "end": c["end"]})
    for own in base:
        own.sort(key=lambda s: (s["start"], s["kind"]))
    return base


def _scored(batches: Iterator[pa.RecordBatch], base: str, cand: str, net: Network | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(_spans(batch, base, cand, net), _BASE)], ["doc_id", "spans"])


def secret_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) of every row; spans are (start, kind, end) in code points, kind an index of KINDS.

    Null texts count as empty and have no spans.  Repeated rows are each
    searched, long texts whole.  A corpus with fewer than eight findings or
    eight other candidates gets the rules alone.  Columns other than doc_id and
    text are not looked at.  An empty table has no rows.
    """
    found, base, cand = searched(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id"])
    net = docs.sparkSession.sparkContext.broadcast(fitted(found, cand))
    return found.mapInArrow(lambda it: _scored(it, base, cand, net.value), f"doc_id long, spans {SPANS}")


def _redact(batches: Iterator[pa.RecordBatch], base: str, cand: str, net: Network | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = [n for n in batch.schema.names if n not in (base, cand)]
        texts = batch.column("text").to_pylist()
        sizes = batch.column("n_chars").to_pylist() if "n_chars" in names else [None] * len(texts)
        for i, spans in enumerate(_spans(batch, base, cand, net)):
            if spans:
                out, at = [], 0
                for a, b in sorted((s["start"], s["end"]) for s in spans):
                    if a > at or not out:
                        out += [texts[i][at:a], "[SECRET]"]
                    at = max(at, b)
                texts[i] = "".join([*out, texts[i][at:]])
                sizes[i] = len(texts[i])
        made = {"text": texts, "n_chars": sizes}
        yield pa.RecordBatch.from_arrays([pa.array(made[n], batch.schema.field(n).type) if n in made else batch.column(n) for n in names], names)


def redacted(docs: DataFrame) -> DataFrame:
    """The documents with every found span replaced by ``[SECRET]``, and ``n_chars``, if there, to match; all rows stay.

    Spans that touch or overlap are one.  Null texts stay null, texts without
    spans as they are, with their ``n_chars``.  Repeated rows are each redacted.
    All other columns pass through, whatever their names.  An empty table has no
    rows.
    """
    found, base, cand = searched(docs, docs.columns)
    net = docs.sparkSession.sparkContext.broadcast(fitted(found, cand))
    return found.mapInArrow(lambda it: _redact(it, base, cand, net.value), docs.schema)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(table(spark, sf_dir, "documents"))
    kinds = F.array(*map(F.lit, KINDS))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["end"])), ",")
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        of(0).alias("n_assign"),
        of(1).alias("n_access"),
        of(2).alias("n_hex"),
        F.sha2(joined(F.filter("spans", lambda s: s["kind"] < 3)), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
