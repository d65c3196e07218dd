"""Operator 11: personal data by rules, and a conditional random field beside them.

Four rules find e-mail and network addresses, card and phone numbers.  A
linear-chain conditional random field (``crf``) reads all tokens of every text by
word shape, and adds what the rules miss: other spellings, and numbers that a
rule's match swallowed.  Stretches around digits and ``@`` are decoded as they
are; of all other tokens the field first weighs every label against none
(``Tagger.signals``).  Where no label can win, whatever stands beside it, the best
labelling is none, and only stretches around the other tokens are decoded.
It is trained from a
small labelled table: stretches of the corpus labelled by the rules, ``SAMPLE``
of each kind by hash, each once as it stands and once with its finding spelt in
another way that the rules do not know; stretches without findings, around digits
and of plain words, as they are and with numbers of other kinds in them (dates, prices, versions, numbers that
fail a rule's test).  Stretches without findings may hold some that the rules
miss, so a first field, which has seen none of them, takes those out in which it
finds any.  A fifth of the table is held out; the confidence that a found span
needs is set there, so that at most ``FALSE`` spans come from a clean stretch.

One pass reads the texts and writes them with the rules' spans and the stretches;
training reads the stretches, decoding all.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabguard.llm.crf import NEVER, OFFSETS, WIDTH, Field
from tabguard.llm.shared import saved, table, unused

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, *(f"model_{k}" for k in BASE))
# fixed values: the rules
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]+")

#: characters read on each side of a digit or @, and the longest stretch that is learnt from
WIDE, LEARNT = 40, 240
SAMPLE = 600
FALSE = 0.001
SURE = 0.5


def luhn(digits: str) -> bool:
    """Every second digit from the right is doubled, its own digits added; the sum ends in 0."""
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and LOCAL.match(text, start - 1):
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def rule_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all rule matches, by start, then kind."""
    out = [(a, 0, b) for a, b in _emails(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in m[0].split("."))]
    for kind, rule, least, most in ((2, CARD, 12, 19), (3, PHONE, 9, 15)):
        for m in rule.finditer(text) if kind == 2 or "+" in text else ():
            digits = "".join(DIGITS.findall(m[0]))
            if least <= len(digits) <= most and (kind == 3 or luhn(digits)):
                out.append((m.start(), kind, m.end()))
    return sorted(out)


_SIGNAL = re.compile(r"[0-9@]+")


def stretches(text: str, wide: int = WIDE, more: list[tuple[int, int]] | None = None) -> list[tuple[int, int]]:
    """The characters around all digits and @, and around the places in ``more``; those that touch as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted([*(m.span() for m in _SIGNAL.finditer(text)), *(more or [])]):
        lo, hi = max(0, a - wide), min(len(text), b + wide)
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def plain_words(text: str, wide: int = WIDE) -> tuple[int, int] | None:
    """A stretch without digits and @, at a place dealt by hash; to learn from."""
    if len(text) < 2 * wide:
        return None
    lo = zlib.crc32(text.encode("utf-8", "replace")) % (len(text) - 2 * wide + 1)
    return None if _SIGNAL.search(text, lo, lo + 2 * wide) else (lo, lo + 2 * wide)


# ---- what the field sees ---------------------------------------------------------

_TOKEN = re.compile(r"([^\W\d_]+|[0-9]+|\S)|\s+")
_GAP_TOKEN = re.compile(r"(\s*)([^\W\d_]+|[0-9]+|\S)")
_JOINTS = set("+().-/ ")
#: (gap, token) pairs whose weights a task keeps at a time
MOST_KNOWN = 200_000


def _hashed(*parts) -> int:
    return zlib.crc32(repr(parts).encode()) % (WIDTH - 1) + 1


@lru_cache(maxsize=50_000)
def _own(token: str) -> tuple[int, int, str]:
    """Features of a token by itself: its shape, its text, and what it is in a number's shape."""
    if token[0].isdigit() and token.isascii():
        value = "big" if len(token) > 3 else "byte" if int(token) < 256 else "over"
        return _hashed("d", min(len(token), 20)), _hashed("v", value, token[0] == "0", len(token) == 1), str(min(len(token), 20))
    if token.isalpha():
        case = "l" if token.islower() else "u" if token.isupper() else "t" if token.istitle() else "m"
        return _hashed(case, min(len(token), 8)), _hashed("w", token.lower() if len(token) <= 8 else "long"), "x"
    return _hashed("p", token), _hashed("p", token), token


def tokens(text: str) -> tuple[list[tuple[int, int]], np.ndarray]:
    """(start, end) of each token, and its features: three that neighbours see, four of the number it stands in."""
    places, own, gaps, gap = [], [], [], 0
    for m in _TOKEN.finditer(text):
        if m[1] is None:
            gap = 1 if m[0] == " " else 2
            continue
        places.append(m.span())
        own.append(_own(m[1]))
        gaps.append(gap)
        gap = 0
    x = np.zeros((len(places), 7), np.int64)
    for i, (o, g) in enumerate(zip(own, gaps, strict=True)):
        x[i, :3] = o[0], o[1], (o[0] * 3 + g) % (WIDTH - 1) + 1
    joint = lambda i: text[places[i][0]].isdigit() or own[i][2] in _JOINTS
    i = 0
    while i < len(places):
        j = i
        while j < len(places) and joint(j) and (j == i or gaps[j] < 2):
            j += 1
        if j > i:
            _number(text, places, own, gaps, x, i, j)
        i = max(j, i + 1)
    return places, x


def _number(text: str, places: list, own: list, gaps: list, x: np.ndarray, i: int, j: int) -> None:
    groups = [k for k in range(i, j) if text[places[k][0]].isdigit()]
    if not groups:
        return
    digits = "".join(text[places[k][0] : places[k][1]] for k in groups)
    shape = "".join((" " if gaps[k] and k > i else "") + own[k][2] for k in range(i, min(j, i + 24)))
    last, size = groups[-1], len(digits)
    whole, total = _hashed("c", shape), _hashed("n", min(size, 30), 12 <= size <= 19 and luhn(digits), len(groups) == 1)
    for k in range(i, j):
        before = sum(g < k for g in groups[:14])
        x[k, 3:] = whole, total, _hashed("at", min(before, 13), min(len(groups), 13), k > last), _hashed("s", shape, before)


# ---- the labelled table ----------------------------------------------------------


def _respelt(kind: int, value: str, r: np.random.RandomState) -> str:
    """A finding in a spelling that its rule does not know."""
    pick = lambda *ways: ways[r.randint(len(ways))]
    if kind == 0:
        name, _, domain = value.partition("@")
        at, dot = pick((" @ ", "."), ("(at)", "."), ("[at]", "[dot]"), (" (at) ", " (dot) "), (" [at] ", "."))
        return name + at + domain.replace(".", dot)
    if kind == 1:
        return value.replace(".", pick("[.]", " . ", "(.)"))
    digits = "".join(DIGITS.findall(value))
    if kind == 2:
        return pick(".", "/", "  ", " - ", "_").join(digits[i : i + 4] for i in range(0, len(digits), 4))
    area, mid, end = digits[-10:-7], digits[-7:-4], digits[-4:]
    return pick(f"({area}) {mid}-{end}", f"1 ({area}) {mid}-{end}", f"{area}-{mid}-{end}", f"{area}.{mid}.{end}", f"001 {area} {mid} {end}", f"+1/{area}/{mid}-{end}", f"{area} {mid} {end}")


def _decoy(r: np.random.RandomState) -> str:
    """A number, or an @, that is no personal data."""
    n = lambda lo, hi: int(r.randint(lo, hi))
    run = "".join(str(n(0, 10)) for _ in range(n(5, 20)))
    if 12 <= len(run) <= 19 and luhn(run):
        run = run[:-1] + str((int(run[-1]) + 1) % 10)
    ways = (
        f"{n(1900, 2100)}-{n(1, 13):02}-{n(1, 29):02}", f"{n(1, 29):02}.{n(1, 13):02}.{n(1900, 2100)}", f"{n(1, 13)}/{n(1, 29)}/{n(1900, 2100)}", f"{n(1990, 2030)}-{n(1990, 2030)}",
        f"{n(0, 24):02}:{n(0, 60):02}", f"{n(0, 24):02}:{n(0, 60):02}:{n(0, 60):02}", f"${n(1, 999)},{n(0, 999):03}.{n(0, 99):02}", f"{n(0, 99)}.{n(0, 99)}", f"v{n(0, 20)}.{n(0, 20)}.{n(0, 99)}",
        f"{n(256, 999)}.{n(0, 256)}.{n(0, 256)}.{n(256, 999)}", f"{n(1, 99)}.{n(1, 99)}.{n(1, 99)}", str(n(0, 10)), str(n(10, 100_000)), run, f"{n(0, 100)}%", f"#{n(1, 9999)}", f"{n(100, 999)}-{n(10, 99)}",
        f"@{'abcdefgh'[: n(2, 8)]}{n(0, 99)}", f"{n(1, 500)} x {n(1, 500)}", f"({n(1, 99)})", f"[{n(1, 99)}, {n(1, 99)}]", f"{n(1, 30)}:{n(1, 150)}-{n(1, 150)}", f"{r.bytes(8).hex()}", f"({n(100, 999)}) {n(10, 99)}", f"{n(1, 9)} {n(100, 999)} {n(100, 999)}",
    )
    return ways[r.randint(len(ways))]


def _put(text: str, at: int, to: int, new: str) -> tuple[str, int, int]:
    return text[:at] + new + text[to:], at, at + len(new)


def examples(found: list[tuple[str, list[tuple[int, int, int]]]], clean: list[str], seed: int = 6) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """(text, spans) to learn from, each stretch as it is and once changed; neighbours of a changed span move with it."""
    r, out = np.random.RandomState(seed), []
    for text, spans in found:
        out.append((text, spans))
        a, kind, b = spans[r.randint(len(spans))]
        if sum(x < b and y > a for x, _, y in spans) > 1:
            continue
        new, lo, hi = _put(text, a, b, _respelt(kind, text[a:b], r))
        moved = hi - b
        out.append((new, sorted([(lo, kind, hi), *[(x + moved * (x >= b), k, y + moved * (x >= b)) for x, k, y in spans if (x, y) != (a, b)]])))
    kinds = {k: [t[a:b] for t, s in found for a, j, b in s if j == k] for k in range(4)}
    for text in clean:
        out.append((text, []))
        spaces = [m.start() + 1 for m in re.finditer(" ", text)] or [0]
        at = spaces[r.randint(len(spaces))]
        out.append((_put(text, at, at, _decoy(r) + " ")[0], []))
        if kinds[2] and kinds[3] and r.rand() < 0.2:  # two numbers that a rule takes for one
            one, two = (kinds[k][r.randint(len(kinds[k]))] for k in r.permutation([2, 3]))
            plain = re.sub("[0-9@]", "", text)
            at = min(at, len(plain))
            new, lo, hi = _put(plain, at, at, f"{one} {two}")
            k = 3 if "+" in one or "(" in one else 2
            out.append((new + " ", [(lo, k, lo + len(one)), (hi - len(two), 5 - k, hi)]))
    return out


def _labels(places: list[tuple[int, int]], spans: list[tuple[int, int, int]]) -> np.ndarray:
    """0 outside, 1 + 2 k at the start of a span of kind k, 2 + 2 k within; where spans overlap, the first."""
    y, last = np.zeros(len(places), np.int64), None
    for i, (a, b) in enumerate(places):
        own = next(((x, k) for x, k, z in spans if a < z and b > x), None)
        if own:
            y[i] = 1 + 2 * own[1] + (own == last)
        last = own
    return y


def _allowed() -> np.ndarray:
    """A label within a span follows one of the same kind."""
    out = np.ones((9, 9), bool)
    for k in range(4):
        out[:, 2 + 2 * k] = False
        out[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = True
    return out


class Tagger:
    def __init__(self):
        self.field, self.least, self.recall = Field(9, _allowed(), 3, 4), SURE, 0.0

    def found(self, texts: list[str]) -> list[list[tuple[int, int, int, float]]]:
        """(start, kind, end, confidence) of each text: the least probability of the labels of a span."""
        read = [tokens(t) for t in texts]
        out: list[list[tuple[int, int, int, float]]] = [[] for _ in texts]
        full = [i for i, (p, _) in enumerate(read) if p]
        if not full:
            return out
        starts = np.concatenate([[0], np.cumsum([len(read[i][0]) for i in full])])
        labels, sure = self.field.decode(np.concatenate([read[i][1] for i in full]), starts[:-1])
        for i, lo, hi in zip(full, starts, starts[1:], strict=False):
            own, p = labels[lo:hi].tolist(), sure[lo:hi].tolist()
            for j, y in enumerate(own):
                if y % 2:
                    k = j + 1
                    while k < len(own) and own[k] == y + 1:
                        k += 1
                    out[i].append((read[i][0][j][0], y // 2, read[i][0][k - 1][1], min(p[j:k])))
        return out

    def signals(self, texts: list[str]) -> list[list[tuple[int, int]]]:
        """(start, end) of the tokens of each text at which a label other than none may win; no best labelling has a span without one.

        A label's gain is what it adds over none at a token, with the best step
        that leads to it; the numbers' own features are left out, since stretches
        around digits are decoded anyway.
        """
        if not hasattr(self, "known"):
            self._weigh()
        width = len(OFFSETS) // 2
        ids, sizes = [np.zeros(width, np.int64)], []
        for text in texts:
            found = _GAP_TOKEN.findall(text.rstrip())
            own = list(map(self.known.get, found))
            if None in own:
                own = [self.known.setdefault(f, len(self.known) + 1) if k is None else k for f, k in zip(found, own, strict=True)]
            ids += [np.array(own, np.int64), np.zeros(width, np.int64)]
            sizes.append(len(own))
        self._learn()
        flat, gain, wide = np.concatenate(ids), self.gain, self.wide
        won = np.zeros(len(flat), bool)
        for lo in range(width, len(flat) - width, 100_000):
            hi = min(lo + 100_000, len(flat) - width)
            # first by the largest gain of any label at each offset, then label by label
            top = sum(self.top[j][flat[lo + d : hi + d]] for j, d in enumerate(OFFSETS)) + self.bonus.max()
            some = lo + np.flatnonzero(top > 0)
            won[some] = (sum(gain[flat[some + d], j] for j, d in enumerate(OFFSETS)) + self.bonus).max(1) > 0
        out, at = [], width
        for n in sizes:
            own, hit = flat[at : at + n], np.flatnonzero(won[at : at + n])
            ends = np.cumsum(wide[own, 0]) if len(hit) else None
            out.append([(int(ends[i] - wide[own[i], 1]), int(ends[i])) for i in hit])
            at += n + width
        if len(self.known) > MOST_KNOWN:
            self._weigh()
        return out

    def _weigh(self) -> None:
        f = self.field
        self.known: dict[tuple[str, str], int] = {}
        self.gain, self.wide = self._gain(np.zeros((1, 3), np.int64)), np.zeros((1, 2), np.int64)
        self.top = np.ascontiguousarray(self.gain.max(2).T)
        none = f.weight[f.features * len(OFFSETS) :, 0].sum(0)  # of the features of numbers, where there is none
        leave = max(0.0, float((f.step[1:, 0] - f.step[0, 0]).max()))
        enter = np.maximum(np.where(f.allowed, f.step, NEVER).max(0)[1:] - f.step[0, 0], f.start[1:] - f.start[0])
        self.bonus = (none[1:] - none[0] + enter + leave + 1e-4).astype(np.float32)

    def _gain(self, x: np.ndarray) -> np.ndarray:
        """(tokens, offsets, labels): what each label gains over none at each offset from a token."""
        out = np.zeros((len(x), len(OFFSETS), self.field.labels - 1), np.float32)
        for j in range(len(OFFSETS)):
            e = sum(self.field.weight[j * 3 + i, x[:, i]] for i in range(3))
            out[:, j] = e[:, 1:] - e[:, :1]
        return out

    def _learn(self) -> None:
        """The weights of what is known since the last time."""
        new = list(itertools.islice(self.known, len(self.gain) - 1, None))
        if new:
            own = [(*_own(token)[:2], 0 if not gap else 1 if gap == " " else 2) for gap, token in new]
            x = np.array([(a, b, (a * 3 + g) % (WIDTH - 1) + 1) for a, b, g in own], np.int64)
            self.gain = np.concatenate([self.gain, self._gain(x)])
            self.top = np.ascontiguousarray(self.gain.max(2).T)
            self.wide = np.concatenate([self.wide, np.array([(len(gap) + len(token), len(token)) for gap, token in new], np.int64)])

    def train(self, rows: list[tuple[str, list[tuple[int, int, int]]]]) -> None:
        read = [(tokens(t), s) for t, s in rows]
        read = [(p, x, s) for (p, x), s in read if p]
        starts = np.concatenate([[0], np.cumsum([len(p) for p, _, _ in read])[:-1]])
        self.field.train(np.concatenate([x for _, x, _ in read]), starts, np.concatenate([_labels(p, s) for p, _, s in read]))

    def calibrate(self, rows: list[tuple[str, list[tuple[int, int, int]]]], allowed: float = FALSE) -> None:
        """The confidence above which at most ``allowed`` spans a clean text are found, and the recall it leaves."""
        clean = [t for t, s in rows if not s]
        false = sorted((c for own in self.found(clean) for *_, c in own), reverse=True)
        spare = int(allowed * len(clean))
        self.least = max(SURE, np.nextafter(false[spare], 2)) if len(false) > spare else SURE
        full = [(t, s) for t, s in rows if s]
        hits = [(a, k, b) in {x[:3] for x in own if x[3] >= self.least} for (_, s), own in zip(full, self.found([t for t, _ in full]), strict=True) for a, k, b in s]
        self.recall = float(np.mean(hits)) if hits else 0.0


# ---- the operator ------------------------------------------------------------------

SPANS = "array<struct<start:int,kind:int,end:int>>"
PARTS = "array<struct<start:int,text:string>>"
_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
_PART = pa.list_(pa.struct([("start", pa.int32()), ("text", pa.string())]))


def _find(batches: Iterator[pa.RecordBatch], keep: list[str], base: str, parts: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans, read = [], []
        for value in batch.column("text"):
            value = value.as_py() or ""
            spans.append([{"start": a, "kind": k, "end": b} for a, k, b in rule_spans(value)])
            words = plain_words(value)
            read.append([{"start": a, "text": value[a:b]} for a, b in [*stretches(value), *([words] if words else [])]])
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(spans, _SPAN), pa.array(read, _PART)], [*keep, base, parts])


def searched(docs: DataFrame, keep: list[str]) -> tuple[DataFrame, str, str]:
    """The kept columns, with the rules' spans, and the stretches around digits and @ and of plain words; and the names of these two columns."""
    base, parts = unused(docs, "base"), unused(docs, "parts")
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(base, T.DataType.fromDDL(SPANS)), T.StructField(parts, T.DataType.fromDDL(PARTS))])
    return saved(docs.mapInArrow(lambda it: _find(it, keep, base, parts), schema), "personal-data"), base, parts


def labelled_table(found: DataFrame, base: str = "base", parts: str = "parts", sample: int = SAMPLE) -> tuple[list[tuple[str, list[tuple[int, int, int]]]], list[str]]:
    """Of the corpus, stretches with findings, ``sample`` of each kind, twice as many without, and as many of plain words, the first by hash of their text."""
    flat = found.select(F.explode(parts).alias("p"), F.col(base).alias("s")).select("p.start", "p.text", "s").where(F.length("text") <= LEARNT)
    inside = F.filter("s", lambda s: (s["start"] >= F.col("start")) & (s["end"] <= F.col("start") + F.length("text")))
    own = F.transform(inside, lambda s: F.struct((s["start"] - F.col("start")).alias("start"), s["kind"].alias("kind"), (s["end"] - F.col("start")).alias("end")))
    rows = saved(flat.select("text", own.alias("spans")).distinct(), "personal-data-stretches")
    first = lambda df, n: df.orderBy(F.xxhash64("text"), "text").limit(n).collect()
    picked = {r["text"]: [tuple(s) for s in r["spans"]] for k in range(len(BASE)) for r in first(rows.where(F.exists("spans", lambda s: s["kind"] == k)), sample)}
    bare, signal = rows.where(F.size("spans") == 0), F.col("text").rlike("[0-9@]")
    return sorted(picked.items()), [r["text"] for part, n in ((bare.where(signal), 2 * sample), (bare.where(~signal), sample)) for r in first(part, n)]


def fitted(found: DataFrame, base: str = "base", parts: str = "parts", sample: int = SAMPLE, allowed: float = FALSE) -> Tagger | None:
    """The tagger, or none where the corpus has fewer than eight labelled stretches with findings."""
    full, clean = labelled_table(found, base, parts, sample)
    if len(full) < 8:
        return None
    bare = [t for t in (re.sub("[0-9@]", "", t) for t, _ in full) if t.strip()][: 2 * sample]  # decoys go in here
    apart = lambda t: zlib.crc32(t.encode()) % 5 == 0
    own = lambda held: ([x for x in full if apart(x[0]) == held], [t for t in bare if apart(t) == held])
    first = Tagger()
    first.train(examples(*own(False)))
    clean = [t for t, spans in zip(clean, first.found(clean), strict=True) if all(sure < SURE for *_, sure in spans)]
    both = lambda held, seed: examples(own(held)[0], own(held)[1] + [t for t in clean if apart(t) == held], seed)
    tagger = Tagger()
    tagger.train(both(False, 6))
    tagger.calibrate(both(True, 7), allowed)
    return tagger


def _spans(batch: pa.RecordBatch, base: str, tagger: Tagger | None) -> list[list[dict]]:
    """The spans of each row, those that the tagger adds among them, in order."""
    out = batch.column(base).to_pylist()
    if tagger is not None:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        flat = [(i, a, t[a:b]) for i, (t, own) in enumerate(zip(texts, tagger.signals(texts), strict=True)) for a, b in stretches(t, more=own)]
        for lo in range(0, len(flat), 2_000):
            part = flat[lo : lo + 2_000]
            for (i, at, _), own in zip(part, tagger.found([t for _, _, t in part]), strict=True):
                for a, k, b, sure in own:
                    a, b = a + at, b + at
                    if sure >= tagger.least and not any(s["kind"] < len(BASE) and s["start"] < b and s["end"] > a for s in out[i]):
                        out[i].append({"start": a, "kind": len(BASE) + k, "end": b})
    for own in out:
        own.sort(key=lambda s: (s["start"], s["kind"]))
    return out


def _scored(batches: Iterator[pa.RecordBatch], base: str, tagger: Tagger | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(_spans(batch, base, tagger), _SPAN)], ["doc_id", "spans"])


def personal_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) of every row; spans are (start, kind, end) in code points, kind an index of KINDS.

    Null texts count as empty and have no spans.  Repeated rows are each
    searched, long texts whole.  What the field adds never overlaps a rule's
    span; it looks at every token, whether a digit is near or not.  A corpus with fewer than eight stretches that hold findings gets the rules
    alone.  Columns other than doc_id and text are not looked at.  An empty table
    has no rows.
    """
    found, base, parts = searched(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id", "text"])
    sent = docs.sparkSession.sparkContext.broadcast(fitted(found, base, parts))
    return found.mapInArrow(lambda it: _scored(it, base, sent.value), f"doc_id long, spans {SPANS}")


def _masked(batches: Iterator[pa.RecordBatch], base: str, parts: str, tagger: Tagger | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = [n for n in batch.schema.names if n not in (base, parts)]
        texts = batch.column("text").to_pylist()
        for i, spans in enumerate(_spans(batch, base, tagger)):
            out, at = [], 0
            for s in spans:
                if s["start"] >= at:
                    out += [texts[i][at : s["start"]], f"[{BASE[s['kind'] % len(BASE)].upper()}]"]
                at = max(at, s["end"])
            if spans:
                texts[i] = "".join([*out, texts[i][at:]])
        yield pa.RecordBatch.from_arrays([pa.array(texts, batch.schema.field("text").type) if n == "text" else batch.column(n) for n in names], names)


def masked(docs: DataFrame) -> DataFrame:
    """The documents with ``[EMAIL]``, ``[IP]``, ``[CARD]`` or ``[PHONE]`` for every span; of spans that overlap, for the first.

    All rows and columns stay, null texts too.
    """
    found, base, parts = searched(docs, docs.columns)
    sent = docs.sparkSession.sparkContext.broadcast(fitted(found, base, parts))
    return found.mapInArrow(lambda it: _masked(it, base, parts, sent.value), docs.schema)


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_spans(table(spark, sf_dir, "documents"))
    kinds = F.array(*map(F.lit, KINDS))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["end"])), ",")
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{BASE[k]}")
    return found.select("doc_id", *[of(k) for k in range(len(BASE))], F.sha2(joined(F.filter("spans", lambda s: s["kind"] < len(BASE))), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
