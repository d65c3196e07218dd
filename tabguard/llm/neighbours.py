"""Operator 7: nearest neighbours by an inverted file with product-quantised residuals.

Coarse centroids and the residual codebooks are fitted on a bounded sample
(``SAMPLE`` vectors, the smallest by hash); the number of lists grows with the
square root of the table.  Every vector is then indexed: its list, and one byte
per subspace of its residual.  The index is written in order of lists, cut
where the rows fall evenly, so that a list which holds a third of all rows is
many tasks.

Queries reach the index in blocks of at most ``QUERY_BYTES``, one broadcast per
block; vectors are not shuffled again.  A task goes through the lists it holds
and ranks their members for the queries that probe the list by asymmetric
distance tables.  Each vector keeps what its codes have lost: no inner product
is above its rough score by more than that times the query's length, so all that
can be among the k nearest, and no others, are scored on the original vectors in
double precision.  A task gives at most ``k`` rows per query.

Lists are probed in two rounds.  The first takes as many as the sample asks for:
the smallest share with which ``TRIED`` of its vectors find ``TARGET`` of their
true neighbours in it, copies aside.  The k-th score that a query has then is a
bound: the second round opens every list left whose centroid and radius allow a
higher or equal one.  The result is that of brute force on any rows, whatever the
sample has seen.  Vectors that lie in clusters need few lists; where they are spread
evenly over the sphere all lists are needed, and the search then is a blocked
product of all queries with all vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabguard.llm.shared import partitions, saved, table

NEAREST = 20
SAMPLE = 16_384
MOST_LISTS = 1_024
MEMBERS = 64
TRIED = 256
TARGET = 0.98
SUBSPACES = 32
CODES = 64
QUERY_BYTES = 32_000_000
SOME = 256
CELLS = 4_000_000
RERANK = 4
ROUNDS = 8
#: what rounding adds to a score at most, as a share of the lengths that make it
ROUNDING = 1e-12


def kmeans(points: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 5) -> np.ndarray:
    """Centroids of Lloyd's algorithm; empty ones take the points farthest from theirs."""
    rng = np.random.RandomState(seed)
    distinct = np.unique(points, axis=0)
    k = min(k, len(distinct))
    centres = distinct[rng.choice(len(distinct), k, replace=False)].copy()
    for _ in range(rounds):
        distance = (points**2).sum(1)[:, None] - 2 * points @ centres.T + (centres**2).sum(1)
        own = distance.argmin(1)
        count = np.bincount(own, minlength=k)
        total = np.zeros_like(centres)
        np.add.at(total, own, points)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
        empty = np.flatnonzero(count == 0)
        if len(empty):
            centres[empty] = points[np.argsort(distance[np.arange(len(points)), own])[::-1][: len(empty)]]
    return centres


class Index:
    """Coarse centroids and residual codebooks; its size depends on the parameters alone."""

    def __init__(self, sample: np.ndarray, lists: int, subspaces: int, codes: int):
        self.dim = sample.shape[1]
        self.coarse = kmeans(sample, lists)
        left = sample - self.coarse[self.assign(sample)]
        self.parts = np.array_split(np.arange(self.dim), min(subspaces, self.dim))
        self.books = [kmeans(left[:, p], codes, seed=7 + i) for i, p in enumerate(self.parts)]

    def assign(self, x: np.ndarray) -> np.ndarray:
        return ((self.coarse**2).sum(1) - 2 * x @ self.coarse.T).argmin(1)

    def encode(self, x: np.ndarray, own: np.ndarray) -> np.ndarray:
        left = x - self.coarse[own]
        return np.stack([((b**2).sum(1) - 2 * left[:, p] @ b.T).argmin(1) for p, b in zip(self.parts, self.books, strict=True)], 1).astype(np.uint8)

    def far(self, x: np.ndarray, own: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How far vectors lie from their centroids, and from what their codes say; with what rounding may add to a score."""
        said = np.concatenate([b[codes[:, m]] for m, b in enumerate(self.books)], 1)
        left = x - self.coarse[own]
        slack = ROUNDING * (np.linalg.norm(x, axis=1) + np.linalg.norm(self.coarse[own], axis=1) + np.linalg.norm(said, axis=1))
        return np.linalg.norm(left, axis=1) + slack, np.linalg.norm(left[:, np.concatenate(self.parts)] - said, axis=1) + slack

    def order(self, q: np.ndarray) -> np.ndarray:
        """Each query's lists, those first whose centroids have the largest inner product with it."""
        return np.argsort(-(q @ self.coarse.T), axis=1, kind="stable")

    def share(self, sample: np.ndarray, k: int, target: float, tried: int = TRIED) -> float:
        """The smallest share of lists that holds ``target`` of the k nearest of different sample vectors."""
        # copies of one vector find each other anywhere
        sample = sample[np.sort(np.unique(sample, axis=0, return_index=True)[1])]
        q, own = sample[:tried], self.assign(sample)
        score = q @ sample.T
        score[np.arange(len(q)), np.arange(len(q))] = -np.inf
        k = min(k, len(sample) - 1)
        if k < 1:
            return 1.0
        near = np.argpartition(-score, k - 1, axis=1)[:, :k]
        place = np.argsort(self.order(q), axis=1)  # at which turn a list is probed
        needed = np.sort(np.take_along_axis(place, own[near], 1).ravel()) + 1
        return float(needed[min(int(np.ceil(target * len(needed))), len(needed)) - 1]) / len(self.coarse)

    def tables(self, q: np.ndarray) -> list[np.ndarray]:
        """For each subspace, the inner products of the queries' parts with its codes."""
        return [q[:, p] @ b.T for p, b in zip(self.parts, self.books, strict=True)]


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): rows with an id whose embedding is non-empty, finite, non-zero and without nulls; equal rows are one."""
    e = F.col("embedding")
    fine = e.isNotNull() & (F.size(e) > 0) & ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(e, lambda x: x != 0)
    return vectors.where(F.col("vec_id").isNotNull() & fine).select(F.col("vec_id").cast("long").alias("vec_id"), e.cast("array<double>").alias("v")).dropDuplicates(["vec_id", "v"])


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, dim)


def _indexed(batches: Iterator[pa.RecordBatch], index: Index) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = _matrix(batch.column("v"), index.dim)
        own = index.assign(x) if len(x) else np.zeros(0, int)
        codes = index.encode(x, own) if len(x) else np.zeros((0, len(index.parts)), np.uint8)
        far, lost = index.far(x, own, codes)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(own.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(far), pa.array(lost)], ["vec_id", "v", "list", "codes", "far", "lost"])


class Asked:
    """A block of queries, which of them probe each list, and the scores that they know to reach."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, index: Index, opened: np.ndarray, least: np.ndarray):
        self.ids, self.q, self.index, self.least = ids, q, index, least
        row, own = np.nonzero(opened)
        by = np.argsort(own, kind="stable")
        self.of = np.split(row[by], np.cumsum(np.bincount(own, minlength=opened.shape[1]))[:-1])


def _likely(q: np.ndarray, index: Index, share: float, sizes: np.ndarray, k: int) -> np.ndarray:
    """Whether each query opens each list in the first round: the share of them, and more until k candidates are there."""
    out = np.zeros((len(q), len(sizes)), bool)
    for lo in range(0, len(q), SOME):
        order = index.order(q[lo : lo + SOME])
        held = np.cumsum(sizes[order], axis=1) - sizes[order]
        opened = (np.arange(order.shape[1])[None, :] < max(1, np.ceil(share * order.shape[1] - 1e-9))) | (held < k + 1)
        np.put_along_axis(out[lo : lo + SOME], order, opened, 1)
    return out


def _possible(q: np.ndarray, index: Index, radius: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Whether each list may hold a vector whose score is not below the query's ``least``."""
    out = np.zeros((len(q), len(radius)), bool)
    for lo in range(0, len(q), SOME):
        own = q[lo : lo + SOME]
        out[lo : lo + SOME] = ~(own @ index.coarse.T + np.linalg.norm(own, axis=1)[:, None] * radius < least[lo : lo + SOME, None])
    return out & (radius >= 0)


def _first(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest scores of each row with their ids, ties to the smaller id."""
    order = np.lexsort((ids, -score), axis=1)[:, :k]
    return np.take_along_axis(score, order, 1), np.take_along_axis(ids, order, 1)


def _of_copies(x: np.ndarray, lo: int, hi: int, most: int) -> np.ndarray:
    """Places lo to hi, of equal vectors only the first ``most``: no query can have more of them among its nearest."""
    same = np.unique(x[lo:hi].view(np.dtype((np.void, x.dtype.itemsize * x.shape[1])))[:, 0], return_inverse=True)[1].ravel()
    order = np.argsort(same, kind="stable")
    first = np.flatnonzero(np.diff(same[order], prepend=-1))
    nth = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    return lo + np.sort(order[nth < most])


def _search(batches: Iterator[pa.RecordBatch], asked: Asked, k: int, rerank: int) -> Iterator[pa.RecordBatch]:
    index, none = asked.index, np.iinfo(np.int64).max
    best, names = np.full((len(asked.q), k), -np.inf), np.full((len(asked.q), k), none)
    for batch in batches:
        lists, ids, lost = batch.column("list").to_numpy(), batch.column("vec_id").to_numpy(), batch.column("lost").to_numpy()
        x = _matrix(batch.column("v"), index.dim)
        codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(len(ids), -1)
        edges = np.flatnonzero(np.diff(lists, prepend=-1, append=-1))
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            probing = asked.of[lists[lo]]
            members = _of_copies(x, lo, hi, k + 1) if hi - lo > k * rerank and len(probing) else np.arange(lo, hi)
            for at in range(0, len(probing), SOME):
                own = probing[at : at + SOME]
                q, other = asked.q[own], ids[members][None, :] != asked.ids[own][:, None]
                least, open_ = np.maximum(asked.least[own], best[own, -1])[:, None], other
                if len(members) > k * rerank:
                    rough = np.repeat((q @ index.coarse[lists[lo]])[:, None], len(members), axis=1)
                    for m, part in enumerate(index.tables(q)):
                        rough += part[:, codes[members, m]]
                    spare = np.linalg.norm(q, axis=1)[:, None] * lost[members]
                    open_ = other & ~(rough + spare < _at_least(np.where(other, rough - spare, -np.inf), k, least))
                # one product tells which of these can be among the nearest; they alone are scored one by one
                some = np.flatnonzero(open_.any(0))
                open_, about = open_[:, some], q @ x[members[some]].T
                spare = ROUNDING * np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x[members[some]], axis=1)
                open_ = open_ & ~(about + spare < _at_least(np.where(open_, about - spare, -np.inf), k, least))
                row, place = np.nonzero(open_)
                if not len(row):
                    continue
                place, score, wide = members[some[place]], np.empty(len(row)), max(1, CELLS // index.dim)
                for i in range(0, len(row), wide):
                    score[i : i + wide] = (x[place[i : i + wide]] * q[row[i : i + wide]]).sum(1)
                count = np.bincount(row, minlength=len(own))
                nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                exact, named = np.full((len(own), count.max()), -np.inf), np.full((len(own), count.max()), none)
                exact[row, nth], named[row, nth] = score, ids[place]
                best[own], names[own] = _first(np.concatenate([best[own], exact], 1), np.concatenate([names[own], named], 1), k)
    row, place = np.nonzero(np.isfinite(best))
    yield pa.RecordBatch.from_arrays([pa.array(asked.ids[row]), pa.array(names[row, place]), pa.array(best[row, place])], ["query_id", "vec_id", "score"])


def _at_least(score: np.ndarray, k: int, least: np.ndarray) -> np.ndarray:
    """What the k-th largest score of each row is at least."""
    return np.maximum(least, np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k, None]) if score.shape[1] >= k else least


NEAR = "query_id long, vec_id long, score double"


def nearest(vectors: DataFrame, queries: DataFrame, k: int = NEAREST, share: float | None = None, rerank: int = RERANK, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest of ``vectors`` but itself, by inner product.

    Both have vec_id and embedding; other columns are not looked at.  Vectors
    that are null, empty, zero or hold null or non-finite components take no
    part, nor do rows without a vec_id, nor vectors of another length than most
    have (of lengths that are equally common, the shortest).  Equal rows are
    one; different vectors of one vec_id all take part, and none is a candidate
    for that id.  A vec_id with several query vectors gets the nearest to any.
    Ties go to the smaller vec_id.  No neighbour is missed.  ``share`` of the
    lists is probed first, by default a measured one; lists of at most ``rerank``
    times k vectors are scored without their codes.  An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows, asked = saved(usable(vectors), "ann-vectors"), usable(queries)
    common = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    if common is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, n = common
    rows, asked = rows.where(F.size("v") == dim), saved(asked.where(F.size("v") == dim), "ann-queries")
    head = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(SAMPLE).select("v").toArrow()
    sample = _matrix(head["v"].combine_chunks(), dim)
    fitted = Index(sample, max(1, min(round(n**0.5 / 2), MOST_LISTS, len(sample) // MEMBERS)), SUBSPACES, CODES)
    if share is None:
        share = fitted.share(sample, k, TARGET)
    index = spark.sparkContext.broadcast(fitted)
    stored = rows.mapInArrow(lambda it: _indexed(it, index.value), "vec_id long, v array<double>, list int, codes binary, far double, lost double")
    stored = saved(stored.repartitionByRange(partitions(spark), "list", F.xxhash64("vec_id")).sortWithinPartitions("list", "vec_id"), "ann-index")
    sizes, radius = np.zeros(len(fitted.coarse), np.int64), np.full(len(fitted.coarse), -1.0)
    for r in stored.groupBy("list").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect():  # one row a list
        sizes[r["list"]], radius[r["list"]] = r["n"], r["far"]
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    blocks = max(1, -(-asked.count() * dim * 8 // query_bytes))
    found = []
    for b in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).toArrow()
        if not own.num_rows:
            continue
        ids, q = own["vec_id"].to_numpy(), _matrix(own["v"].combine_chunks(), dim)

        def search(opened: np.ndarray, least: np.ndarray, ids=ids, q=q) -> DataFrame:
            sent = spark.sparkContext.broadcast(Asked(ids, q, fitted, opened, least))
            part = stored.select("vec_id", "v", "list", "codes", "lost").mapInArrow(lambda it: _search(it, sent.value, k, rerank), NEAR)
            return saved(part.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "ann-found")

        opened = _likely(q, fitted, share, sizes, k)
        first = search(opened, np.full(len(ids), -np.inf))
        found.append(first.drop("rank"))
        known = {r["query_id"]: r["score"] for r in first.where(F.col("rank") == k).select("query_id", "score").collect()}  # a row a query of the block
        least = np.array([known.get(i, -np.inf) for i in ids.tolist()])
        more = _possible(q, fitted, radius, least) & ~opened
        if more.any():
            found.append(search(more, least).drop("rank"))
    every = found[0] if found else spark.createDataFrame([], NEAR)
    for part in found[1:]:
        every = every.unionByName(part)
    return every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))
