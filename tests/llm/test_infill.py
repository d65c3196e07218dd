"""Fill-in-the-middle: the skip list and the whole operator against plain slices."""

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabguard.llm import infill

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")


def plainly(doc_id, text):
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    form = "spm" if h[3] % 100 < 20 else "psm"
    return len(units), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("aZq é9\n<P>S|\U0001f600"), max_size=400), st.integers(0, 500))
def test_cut(text, doc_id):
    assert infill.cut(doc_id, text) == plainly(doc_id, text)
    assert infill.unit_widths(text).tolist() == [len(u) for u in UNIT.findall(text)]


@pytest.mark.parametrize(("n", "fan"), [(0, 4), (1, 4), (5, 4), (3_000, 2), (3_000, 16), (200_000, 16)])
def test_skip_list(n, fan):
    widths = np.random.RandomState(n).randint(1, 30, n)
    links, before = infill.SkipList(widths, fan), np.concatenate([[0], np.cumsum(widths)])
    assert all(units.sum() == n and points.sum() == before[-1] for units, points, _ in links.lanes)
    assert n <= fan or len(links.lanes) > 1
    for rank in {0, n, n // 2, n // 3, max(n - 1, 0), *range(0, n, max(1, n // 60))}:
        assert links.before(rank) == before[rank]


def test_operator(spark):
    texts = [None, "", "x", "a<P>b", "no <marks> P>S", "naïve café 12\n\tend", "\U0001f600 aé" * 90_000, "words of text " * 40, "words of text " * 40]
    rows = [(None if i == 3 else i * 7, t, "n", 1) for i, t in enumerate(texts * 12)] + [(8, "twice", "n", 1)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, n int").repartition(3)
    got = infill.fill_in_middle(docs).withColumn("back", infill.restored(F.col("form"), F.col("output"))).collect()
    assert sorted(map(str, ((r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got))) == sorted(map(str, ((i, t, *plainly(i, t or "")) for i, t, _, _ in rows)))
    assert all(r.back == (r.text or "") for r in got) and {r.form for r in got} == {"plain", "psm", "spm"}
    assert infill.fill_in_middle(docs.limit(0)).collect() == []
