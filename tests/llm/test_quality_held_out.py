"""Quality: the weights behind the threshold by plain counting, and what becomes of documents whose labels were not learnt."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabguard.llm import quality
from tabguard.llm.bytetext import slices


def test_left_out_weights():
    r = random.Random(21)
    texts = [" ".join(r.choice("ab cd ef gh, ij !! kl".split()) for _ in range(r.randrange(0, 30))) for _ in range(12)]
    code = lambda t: quality.grams(*next(slices(pa.array([t])))[2:])[0] if t else np.zeros(0, int)
    own, good = [code(t) for t in texts], [i % 3 == 0 for i in range(12)]
    total = np.zeros((2, quality.BUCKETS))
    for g, y in zip(own, good, strict=True):
        np.add.at(total[0], g, 1)
        np.add.at(total[1], g, y)
    batch = pa.RecordBatch.from_arrays([pa.array(range(12), pa.int64()), pa.array([int(y) for y in good], pa.int32()), pa.array(texts)], ["doc_id", "quality", "text"])
    (got,) = quality._left_out(iter([batch]), total)
    for w, g, y in zip(got.column("log_weight").to_pylist(), own, good, strict=True):
        others = total[1].copy()
        if y:
            np.subtract.at(others, g, 1)
        share = lambda c: (c + quality.SMOOTH) / (c.sum() + quality.SMOOTH * quality.BUCKETS)
        want = (np.log(share(others)[g]) - np.log(share(total[0])[g])).sum() * quality.SPAN / (quality.SPAN + len(g)) if len(g) else -np.inf
        assert w == pytest.approx(want)


def test_held_out_labels(spark):
    """Half of the labels of a small table are learnt: good documents of the other half stay, bad ones go."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    learnt = labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0)
    kept = {r["doc_id"] for r in quality.quality_scores(docs, learnt).where("kept").collect()}
    held = {r["doc_id"]: r["quality"] for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 2}
    of = lambda y: [i in kept for i, q in held.items() if q == y]
    assert np.mean(of(1)) >= 0.95 and np.mean(of(0)) <= 0.1 and len(of(0)) > 15
