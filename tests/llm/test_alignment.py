"""Alignment of two tokenizers: bitmaps, stretches and the whole operator against plain counts."""

import bisect
import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tabguard.llm import alignment, pairbits

tokenizers = pytest.importorskip("tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def pair():
    return alignment.Pair(open(alignment.BYTE_BPE, "rb").read(), open(alignment.PIECE_BPE, "rb").read())


@pytest.fixture(scope="module")
def whole():
    a = tokenizers.Tokenizer.from_file(alignment.BYTE_BPE)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=alignment.PIECE_BPE)
    letters = alignment._byte_letters()
    piece = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()

    def ids(text):
        """(ids of A, of B) with their end offsets; none where they do not give the text."""
        x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        xs, ys = [bytes(letters[c] for c in a.id_to_token(i)) for i in x], [piece(i) for i in y]
        if not text or b"".join(xs) != (" " + text).encode() or b"".join(ys) != (" " + text).encode():
            return None
        return list(zip(x, np.cumsum([*map(len, xs)]).tolist(), strict=True)), list(zip(y, np.cumsum([*map(len, ys)]).tolist(), strict=True))

    return ids


def plainly(texts, ids):
    rows, counts = [], Counter()
    for t in texts:
        found = ids(t) if t else None
        if found is None:
            rows.append(None)
            continue
        a, b = found
        shared = sorted({e for _, e in a} & {e for _, e in b})
        at = lambda side: [i for i, e in side if e in set_of]
        set_of = set(shared)
        links = list(zip(at(a), at(b), strict=True))
        groups = {e: ([], []) for e in shared}
        for k, side in enumerate((a, b)):
            for i, e in side:
                groups[shared[bisect.bisect_left(shared, e)]][k].append(str(i))
        groups = ["|".join(",".join(x) for x in groups[e]) for e in shared]
        counts.update(links)
        rows.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = {}
    for (_, j), n in counts.items():
        best[j] = max(best.get(j, 0), n)
    return [(0, 0, 0, 0, 0, 0, "") if r is None else (*r[:3], len(r[3]), sum(counts[p] == best[p[1]] for p in r[3]), sum(counts[p] for p in r[3]), r[4]) for r in rows], counts


@settings(max_examples=300, deadline=None)
@given(text=st.text(st.sampled_from("aeAthing  \n\t.,'s19é▁\x1c\x85 　ß日😀<|endoftext|>"), max_size=60))
def test_stretches(pair, whole, text):
    """What the stretches give is what the whole text gives."""
    want = whole(text)
    cut = alignment.stretches(text)
    assert "".join(cut) == " " + text and all(s[0] == " " for s in cut)
    made = pair.ids(cut)
    if want is None:
        assert not text or None in pair.aligned(cut)
    else:
        assert [i for a, _ in made for i in a] == [i for i, _ in want[0]]
        assert [j for _, b in made for j in b] == [j for j, _ in want[1]]


@pytest.mark.parametrize("docs", [1, 9, 700, 65_536])
def test_bitmaps(docs):
    r = np.random.RandomState(docs)
    held = {(int(p), int(d)): int(t) for p, d, t in zip(r.randint(0, 40, 3_000) ** 3, r.randint(0, docs, 3_000), r.geometric(0.3, 3_000), strict=True)}
    held |= {(5, d): 1 + d % 3 for d in range(docs)}
    keys = np.array(list(held), np.int64)
    order = r.permutation(len(keys))
    pairs, offsets, data = pairbits.packed(keys[order, 0], keys[order, 1], np.array(list(held.values()))[order], docs)
    n_docs, links = pairbits.counted(offsets, data)
    back = Counter()
    for row, digit, doc in pairbits.planes(offsets, data):
        for a, k, d in zip(row.tolist(), digit.tolist(), doc.tolist(), strict=True):
            back[(int(pairs[a]), d)] += 1 << k
    assert back == held
    assert dict(zip(pairs.tolist(), n_docs.tolist(), strict=True)) == Counter(p for p, _ in held)
    assert dict(zip(pairs.tolist(), links.tolist(), strict=True)) == {p: sum(t for (q, _), t in held.items() if q == p) for p in set(pairs.tolist())}


def test_operator(spark, whole):
    r = random.Random(12)
    words = "the unbelievable tokenization Straße naïve 12,345 x's\n\n re-run <|endoftext|> 日本 café  ".split(" ")
    texts = [None, "", " ", "▁x", "a", "😀", *[" ".join(r.choice(words) for _ in range(r.randrange(1, 50))) for _ in range(60)], "long " * 9_000 + "x" * 3_000]
    texts += [texts[7], texts[7]]
    rows = [(None if i == 9 else i, t, 5, 1, "b") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pair int, block int, n_a string").repartition(3)
    want, counts = plainly(texts, whole)
    for links in (50, alignment.LINKS):
        found = alignment.align(docs, links=links)
        got = found.scored().select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()
        assert sorted(map(str, map(tuple, got))) == sorted(str((i, *w)) for (i, *_), w in zip(rows, want, strict=True))
        pairs = found.pairs.collect()
        assert {(p.a, p.b): p.links for p in pairs} == counts
        held = Counter(p for t in texts for p in plainly([t], whole)[1])
        assert {(p.a, p.b): p.docs for p in pairs} == held
    assert alignment.align(docs.limit(0)).scored().collect() == []
