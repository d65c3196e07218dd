"""Personal data: the rules against their patterns, the field against all labellings, and the operator."""

import itertools
import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tabguard.llm import crf, pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plainly(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])

    def valid(d):
        double = [int(c) * (2 if i % 2 else 1) for i, c in enumerate(reversed(d))]
        return sum(x - 9 if x > 9 else x for x in double) % 10 == 0

    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 12 <= len(digits(m)) <= 19 and valid(digits(m))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]
    return sorted(out)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["a", "b.c", "@", ".", "-", "+", "%", " ", "1", "42", "4111111111111111", "4111 1111 1111 1111", "255", "256", "0", "(", ")", "é", "x@y.z", "1.2.3.4", "+1 (743) 555-3824", "\n"]), max_size=30).map("".join))
def test_rules(text):
    assert pii.rule_spans(text) == plainly(text)


def test_hostile_texts_take_linear_time():
    n = 200_000
    for text in ("1" * n, "a" * n + "@", "a@" * n, "1." * n, "+1" * n, "(1" * 5_000, "a@b." * n, "9 " * n):
        pii.rule_spans(text)
        assert sum(b - a for a, b in pii.stretches(text)) <= len(text)
    assert pii.rule_spans("1." * 40)[0] == (0, 1, 7)


def test_field_against_all_labellings():
    r = np.random.RandomState(3)
    allowed = np.ones((3, 3), bool)
    allowed[0, 2] = False
    field = crf.Field(3, allowed, 2, 1)
    field.weight[:, :12] = r.randn(field.tables, 12, 3)
    field.step += r.randn(3, 3).astype(np.float32) * allowed
    lengths = [1, 4, 5, 2]
    starts, x = np.cumsum([0, *lengths[:-1]]), r.randint(1, 12, (sum(lengths), 3))
    labels, sure = field.decode(x, starts)
    for lo, n in zip(starts, lengths, strict=True):
        e = field.emissions(field._ids(x[lo : lo + n], np.array([0])))
        score = {y: field.start[y[0]] + sum(e[t, v] for t, v in enumerate(y)) + sum(field.step[a, b] for a, b in itertools.pairwise(y)) for y in itertools.product(range(3), repeat=n)}
        best = max(score, key=score.get)
        assert tuple(labels[lo : lo + n]) == best and not any(a == 0 and b == 2 for a, b in itertools.pairwise(best))
        z = np.array(list(score.values()), float)
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        for t in range(n):
            assert abs(sure[lo + t] - sum(q for q, y in zip(p, score, strict=True) if y[t] == best[t])) < 1e-3


def test_field_learns():
    """A label that only the tokens before decide is learnt through transitions and neighbours."""
    r = np.random.RandomState(4)
    x = r.randint(1, 6, (3_000, 1))
    y = (np.concatenate([[0], x[:-1, 0]]) == 3).astype(int)
    field = crf.Field(2, np.ones((2, 2), bool), 1, 0)
    field.train(x, np.arange(0, 3_000, 10), y, epochs=4)
    inner = np.arange(3_000) % 10 > 0
    assert (field.decode(x, np.arange(0, 3_000, 10))[0] == y)[inner].mean() > 0.99


def found_by_hand(r):
    card = lambda: next(c for c in iter(lambda: "4" + "".join(str(r.randrange(10)) for _ in range(15)), 0) if pii.luhn(c))
    return [
        f"{r.choice(['ann', 'bo.li', 'c-d'])}{r.randrange(99)}@mail{r.randrange(9)}.example.com",
        ".".join(str(r.randrange(1, 255)) for _ in range(4)),
        card(),
        f"+1 ({r.randrange(200, 999)}) 555-{r.randrange(1000, 9999)}",
    ]


def test_operator(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("aeinorstlu") for _ in range(r.randrange(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    rows, hidden, clean = [], {}, []
    for i in range(600):
        kind = i % 4
        value = found_by_hand(r)[kind]
        rows.append((i, f"{prose(30)} {value} {prose(30)}"))
    for i in range(600, 640):
        e, ip, card, phone = found_by_hand(r)
        value, kind = [(e.replace("@", "(at)"), 0), (ip.replace(".", "[.]"), 1), (".".join(card[j : j + 4] for j in range(0, 16, 4)), 2), (phone[3:], 3)][i % 4]
        before = prose(30)
        rows.append((i, f"{before} {value} {prose(30)}"))
        hidden[i] = (len(before) + 1, 4 + kind, len(before) + 1 + len(value))
    for i in range(640, 800):
        clean.append(i)
        rows.append((i, f"{prose(20)} {r.choice(['12:30', '2024-05-06', '3.14', 'v1.2.3', '1,200', '#77', '1999', '12 x 40'])} {prose(20)}"))
    rows += [(800, None), (801, ""), (None, "call +1 (743) 555-3824"), (800, "1" * 50_000), (802, rows[0][1]), (802, rows[0][1])]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, base int, spans string").repartition(3)
    got = [(x.doc_id, [tuple(s) for s in x.spans]) for x in pii.personal_spans(docs).collect()]
    assert sorted(map(str, ((i, [s for s in own if s[1] < 4]) for i, own in got))) == sorted(map(str, ((i, plainly(t or "")) for i, t in rows)))
    by = {i: [s for s in own if s[1] >= 4] for i, own in got}
    assert sum(hidden[i] in by[i] for i in hidden) >= 0.9 * len(hidden)
    assert sum(bool(by[i]) for i in clean) <= 2 and sum(bool(by[i]) for i in range(600)) <= 3
    told = {x.doc_id: x for x in pii.masked(docs).collect() if x.doc_id is not None and x.doc_id < 800}
    assert all(told[i].spans == "x" and f"[{pii.BASE[i % 4].upper()}]" in told[i].text for i in range(600))
    assert pii.personal_spans(docs.limit(0)).collect() == [] and len(pii.personal_spans(docs.where("doc_id = 3")).collect()) == 1


def test_every_token_is_looked_at(spark):
    """Respelt addresses far from any digit and @ are found, and no labelling has a span where no token is a signal."""
    r = random.Random(10)
    word = lambda: "".join(r.choice("aeinorstlu") for _ in range(r.randrange(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    name = lambda: f"{r.choice(['ann', 'bo', 'cy'])}.{word()}@{word()}.example.com"
    rows = [(i, f"{prose(30)} {name() if i % 2 else found_by_hand(r)[i % 4]} {prose(30)}") for i in range(600)]
    hidden = {}
    for i in range(600, 640):
        before, value = prose(40), name().replace("@", "(at)")
        rows.append((i, f"{before} {value} {prose(40)}"))
        hidden[i] = (len(before) + 1, 4, len(before) + 1 + len(value))
    rows += [(i, prose(80)) for i in range(640, 840)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {x.doc_id: [tuple(s) for s in x.spans] for x in pii.personal_spans(docs).collect()}
    assert sum(hidden[i] in got[i] for i in hidden) >= 0.9 * len(hidden)
    assert sum(bool(got[i]) for i in range(640, 840)) <= 2
    tagger = pii.fitted(*pii.searched(docs, ["doc_id"]))
    texts = [t for i, t in rows if i >= 600]
    for text, own, places in zip(texts, tagger.found(texts), tagger.signals(texts), strict=True):
        assert all(text[a:b].strip() == text[a:b] for a, b in places)
        assert all(any(x < b and y > a for x, y in places) for a, _, b, _ in own)
