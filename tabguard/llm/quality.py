"""Operator 10: quality by importance resampling.

Two generative models over hashed word and punctuation n-grams (n = 1, 2): one
of the target text (documents labelled good), one of the raw corpus.  A
document's log importance weight is the sum over its n-grams of
``log p_target - log p_raw``, tempered by SPAN / (SPAN + n) so that n n-grams
count as at most ``SPAN`` and a long text does not drift away.  Gumbel noise is
added and the k largest sums are kept, which samples k documents without replacement in proportion to their
weights.  k is the number of documents whose weight reaches the threshold that
the labelled rows give; there each good document is weighed by a target model
that has not counted it, since with few labels a model knows its own documents
far better than others as good.

The raw model counts every document.  The target model and the threshold use a
bounded sample of labels (``SAMPLE`` rows, the smallest by hash), the only side
that is broadcast.  What reaches the driver are the two count vectors of
``BUCKETS`` entries and the sample's weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabguard.llm.bytetext import byte_class, mix, prefix_hash, slices, span_hash, uniform
from tabguard.llm.shared import saved, table

BUCKETS = 1 << 16
SAMPLE = 20_000
RECALL = 0.9995
SMOOTH = 0.1
SPAN = 100
SEED = 17

_SPACE = byte_class(ranges=((0x20, 0x20), (0x09, 0x0D)))
_WORD = byte_class(ranges=((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)))
_KIND = np.where(_SPACE, 0, np.where(_WORD, 1, 2)).astype(np.uint8)


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of a slice, and the row of each."""
    kind = _KIND[data]
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[offsets] = True
    at = np.flatnonzero(edge)
    starts, ends = at[:-1], at[1:]
    real = kind[starts] > 0 if len(data) else np.zeros(0, bool)
    starts, ends = starts[real], ends[real]
    h = span_hash(prefix_hash(data), starts, ends) if len(data) else np.zeros(0, np.uint64)
    row = np.searchsorted(offsets, starts, "right") - 1
    pair = row[1:] == row[:-1]
    two = mix(h[:-1] * np.uint64(0x9FB21C651E98DF25) + h[1:])[pair]
    return (np.concatenate([h, two]) % np.uint64(BUCKETS)).astype(np.int64), np.concatenate([row, row[1:][pair]])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((2, BUCKETS), np.int64)
    for batch in batches:
        good = batch.column("good").to_numpy(zero_copy_only=False).astype(bool)
        for lo, _, data, offsets in slices(batch.column("text")):
            bucket, row = grams(data, offsets)
            total[0] += np.bincount(bucket, minlength=BUCKETS)
            total[1] += np.bincount(bucket[good[lo + row]], minlength=BUCKETS)
    kind, bucket = np.nonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(kind.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(total[kind, bucket])], ["kind", "bucket", "n"])


def _weigh(batch: pa.RecordBatch, ratio: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log weight, number of n-grams, Gumbel noise) of each row; a row without n-grams weighs -inf."""
    weight, n, noise = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
    ids = batch.column("doc_id").cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False)
    for lo, hi, data, offsets in slices(batch.column("text")):
        bucket, row = grams(data, offsets)
        n[lo:hi] = np.bincount(row, minlength=hi - lo)
        weight[lo:hi] = np.bincount(row, weights=ratio[bucket], minlength=hi - lo)
        body = span_hash(prefix_hash(data), offsets[:-1], offsets[1:])
        noise[lo:hi] = -np.log(-np.log(uniform(mix(body + np.uint64(SEED) * mix(ids[lo:hi].astype(np.uint64))))))
    weight *= SPAN / (SPAN + n)
    weight[n == 0] = -np.inf
    return weight, n, noise


def _scores(batches: Iterator[pa.RecordBatch], ratio: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        weight, n, noise = _weigh(batch, ratio)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(n), pa.array(weight), pa.array(weight + noise)], ["doc_id", "n_grams", "log_weight", "key"])


def _keep(batches: Iterator[pa.RecordBatch], ratio: np.ndarray, least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        weight, _, noise = _weigh(batch, ratio)
        yield batch.filter(pa.array(weight + noise >= least))


def label_sample(labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """At most ``size`` labelled doc_ids with one label each (the lowest given), chosen by hash."""
    one = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return one.orderBy(F.xxhash64(F.lit("quality"), "doc_id"), "doc_id").limit(size)


def gram_counts(docs: DataFrame, sample: DataFrame) -> np.ndarray:
    """The n-grams of each bucket: of all documents, and of those labelled good."""
    good = F.broadcast(sample.where("quality = 1").select(F.col("doc_id").alias("_id"), F.lit(True).alias("_good")))
    rows = docs.select("doc_id", "text").join(good, F.col("doc_id") == F.col("_id"), "left").select("text", F.coalesce("_good", F.lit(False)).alias("good"))
    counts = rows.mapInArrow(_count, "kind int, bucket int, n long").groupBy("kind", "bucket").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros((2, BUCKETS))
    total[counts["kind"], counts["bucket"]] = counts["n"]
    return total


def log_ratio(total: np.ndarray) -> np.ndarray:
    """log p_target - log p_raw of each bucket."""
    share = (total + SMOOTH) / (total.sum(axis=1, keepdims=True) + SMOOTH * BUCKETS)
    return np.log(share[1]) - np.log(share[0])


def _left_out(batches: Iterator[pa.RecordBatch], total: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Log weights of labelled rows under a target model that has not counted the row itself."""
    raw, size = np.log(total[0] + SMOOTH) - np.log(total[0].sum() + SMOOTH * BUCKETS), total[1].sum() + SMOOTH * BUCKETS
    for batch in batches:
        weight = np.full(batch.num_rows, -np.inf)
        good = batch.column("quality").to_numpy(zero_copy_only=False) == 1
        for lo, hi, data, offsets in slices(batch.column("text")):
            bucket, row = grams(data, offsets)
            order = np.argsort(row, kind="stable")
            ends = np.searchsorted(row[order], np.arange(hi - lo + 1))
            for i in range(hi - lo):
                own, times = np.unique(bucket[order[ends[i] : ends[i + 1]]], return_counts=True)
                n = int(times.sum())
                if n:
                    mine = good[lo + i]
                    target = np.log(total[1][own] - mine * times + SMOOTH) - np.log(size - mine * n)
                    weight[lo + i] = float((times * (target - raw[own])).sum()) * SPAN / (SPAN + n)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("quality"), pa.array(weight)], ["doc_id", "quality", "log_weight"])


def threshold(weights: np.ndarray, good: np.ndarray, recall: float = RECALL) -> float:
    """The lowest log weight to aim at.

    At least ``recall`` of the good rows lie above it; where the bad rows leave
    a gap below those, it is set into the gap.  Without good rows all are kept,
    without bad ones all that weigh as the good ones do.
    """
    real = np.isfinite(weights)
    yes, no = np.sort(weights[real & good]), np.sort(weights[real & ~good])
    if not len(yes):
        return -np.inf
    low = yes[int((1 - recall) * len(yes))]
    below = no[no < low]
    return float((low + below[-1]) / 2) if len(below) else float(low)


def kth_largest(keys: DataFrame, column: str, k: int, bins: int = 4096) -> float:
    """The k-th largest finite value, found by narrowing histograms; at most ``bins`` counts reach the driver at once."""
    finite = keys.where(F.abs(column) < float("inf")).select(F.col(column).alias("v"))
    lo, hi = finite.agg(F.min("v"), F.max("v")).first()
    while lo is not None and lo < hi:
        width = (hi - lo) / bins
        if width <= 0 or lo + width == lo:
            break
        slot = F.least(F.floor((F.col("v") - lo) / width), F.lit(bins - 1))
        counts = finite.where(F.col("v").between(lo, hi)).groupBy(slot.alias("slot")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
        for r in sorted(counts, key=lambda r: -r["slot"]):
            if k <= r["n"]:
                lo, hi = r["lo"], r["hi"]
                break
            k -= r["n"]
        else:
            break
    return lo if lo is not None else float("inf")


def fitted(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float, DataFrame]:
    """(log ratios, the least key that is kept, scores of all documents)."""
    sample = saved(label_sample(labels).select("doc_id", F.col("quality").cast("int").alias("quality")), "quality-sample")
    total = gram_counts(docs, sample)
    ratio = log_ratio(total)
    context = docs.sparkSession.sparkContext
    sent, counted = context.broadcast(ratio), context.broadcast(total)
    scores = saved(docs.select("doc_id", "text").mapInArrow(lambda it: _scores(it, sent.value), "doc_id long, n_grams long, log_weight double, key double"), "quality-scores")
    # one row for each labelled document, of repeated ones the lowest weight
    own = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").mapInArrow(lambda it: _left_out(it, counted.value), "doc_id long, quality int, log_weight double")
    seen = own.groupBy("doc_id").agg(F.min("log_weight").alias("log_weight"), F.min("quality").alias("quality")).toPandas()
    at = threshold(seen["log_weight"].to_numpy(float), (seen["quality"] == 1).to_numpy(bool))
    k = scores.where(F.col("log_weight") >= F.lit(at)).where(F.abs("log_weight") < float("inf")).count()
    return ratio, kth_largest(scores, "key", k) if k else float("inf"), scores


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_grams, log_weight, key and kept for every document.

    Null and empty texts, and those of white space alone, weigh -inf and are
    not kept.  Columns other than doc_id and text are not looked at.  Repeated rows have equal keys and share their fate, so that ties
    at the k-th key are all kept.  Labels of unknown documents are unused; null
    labels are ignored.  An empty table gives no rows.
    """
    _, least, scores = fitted(docs, labels)
    return scores.withColumn("kept", F.col("key") >= F.lit(least))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that quality_scores keeps, scored again in place instead of joined back; all columns stay as they are.

    Null and empty texts, and those of white space alone, go.  Repeated rows
    share their fate, long texts are weighed whole.  Without labels of good
    documents nothing is judged: all documents with n-grams stay.  An empty
    table has no rows.
    """
    ratio, least, _ = fitted(docs, labels)
    sent = docs.sparkSession.sparkContext.broadcast(ratio)
    return docs.mapInArrow(lambda it: _keep(it, sent.value, least), docs.schema)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
