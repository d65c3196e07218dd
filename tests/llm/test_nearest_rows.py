"""Nearest neighbours on rows that the index's sample says little of: none may be missed."""

import numpy as np
import pytest

from tabguard.llm import neighbours


def rows_of(kind, r, n=6000, dim=24):
    x = (r.randn(40, dim) * 4)[r.randint(0, 40, n)] + r.randn(n, dim)
    if kind == "queries apart":  # what is asked lies between the clusters
        x[::20] = r.randn(len(x[::20]), dim) * 4
    if kind == "lengths":  # a few long vectors are everyone's nearest
        x *= np.exp(r.randn(n) * 1.5)[:, None]
    if kind == "rare":
        x[7::400] *= 25
    return x


@pytest.mark.parametrize("kind", ["queries apart", "lengths", "rare"])
def test_all_nearest_are_found(spark, kind, monkeypatch):
    monkeypatch.setattr(neighbours, "SAMPLE", 1_500)
    x = rows_of(kind, np.random.RandomState(11))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    got = {}
    for row in neighbours.nearest(df, df.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(row["query_id"], []).append(row["vec_id"])
    ids, missed = np.arange(len(x)), 0
    for q in range(0, len(x), 20):
        s = x @ x[q]
        s[q] = -np.inf
        missed += len(set(np.lexsort((ids, -s))[:20].tolist()) - set(got[q]))
    assert missed == 0
