"""Operator 6: benchmark decontamination over a positional inverted index.

``positional_index`` reads the documents once and stores their token postings
as a table.  A row is a shard of some two megabytes of text: its documents, its
distinct terms in order, and for each term the sorted positions at which the
shard has it.  Any number of benchmarks is then searched in that table; the
documents are not read again, nor ever shuffled.

A benchmark window is looked up by taking the postings of its rarest term in
the shard, shifted by the term's offset in the window, and intersecting with
the shifted postings of its other terms from rarest to most common; what is left
are exact phrase occurrences.  Proximity matches start from the same rarest
postings and ask for all terms of the window, in any order, within ``slop`` words.

The benchmark reaches the tasks in blocks of at most ``BLOCK_WORDS`` words (an
item is never split), one broadcast per block.  Terms are 64-bit hashes of words.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabguard.llm.bytetext import LETTERS, lowered_words, slices
from tabguard.llm.shared import saved, table, unused

WINDOW = 10
SLOP = 20
BLOCK_WORDS = 1_000_000
CHUNK = 50_000
GROUP_BYTES = 16_000_000

#: ``first_word`` has one entry more than there are documents, ``first`` one more than there are terms
INDEX = "shard long, doc_id array<long>, digest array<string>, first_word array<int>, term array<long>, first array<int>, postings array<int>"
FOUND = "shard long, nth int, doc_id long, digest string, n_words long, hits array<int>, items array<string>, near array<string>"


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """One list."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shard = TaskContext.get().partitionId() << 33
    for batch in batches:
        for lo, hi, data, offsets in slices(batch.column("text")):
            _, _, ranges, hashes = lowered_words(data, offsets, LETTERS)
            order = np.argsort(hashes, kind="stable")
            terms = hashes[order]
            first = np.flatnonzero(np.concatenate([[True], terms[1:] != terms[:-1]])) if len(terms) else np.zeros(0, int)
            part = batch.slice(lo, hi - lo)
            docs = [pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), part.column(c)) for c in ("doc_id", "digest")]
            numbers = _lists(ranges, pa.int32()), _lists(terms[first].view(np.int64), pa.int64()), _lists(np.append(first, len(terms)), pa.int32()), _lists(order, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), *docs, *numbers], ["shard", "doc_id", "digest", "first_word", "term", "first", "postings"])
            shard += 1


def positional_index(docs: DataFrame) -> DataFrame:
    """The stored postings of all words of ``docs``, a row for each shard (see INDEX).

    Null texts count as empty; documents without words have a place in a shard
    and no postings.  Repeated rows are documents of their own.  A text of any
    length is in one shard.  Columns other than doc_id and text are not looked
    at.  An empty table has no shards.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(text).alias("digest"), text.alias("text"))
    return saved(rows.mapInArrow(_indexed, INDEX), "decontam-index", GROUP_BYTES)


class Phrases:
    """The windows of one block of the benchmark."""

    def __init__(self, items: list[str], texts: list[str], window: int):
        parts = [lowered_words(data, offsets, LETTERS) for _, _, data, offsets in slices(pa.array(texts, pa.string()), 1 << 62)]
        _, _, ranges, hashes = parts[0] if parts else (None, None, np.zeros(1, int), np.zeros(0, np.uint64))
        rows: dict[tuple, set[int]] = defaultdict(set)
        for i in range(len(items)):
            own = hashes[ranges[i] : ranges[i + 1]].tolist()
            for at in range(max(1, len(own) - window + 1) if own else 0):
                rows[tuple(own[at : at + window])].add(i)
        self.items, self.words = items, np.unique(hashes)
        self.length = np.array([len(w) for w in rows], np.int64)
        self.terms = np.full((len(rows), window), -1, np.int64)
        for k, w in enumerate(rows):
            self.terms[k, : len(w)] = np.searchsorted(self.words, np.array(w, np.uint64))
        self.of = [sorted(x) for x in rows.values()]


class Shard:
    """Of a stored shard the postings of a block's terms, one list after the other."""

    def __init__(self, p: Phrases, ranges: np.ndarray, term: np.ndarray, first: np.ndarray, postings: np.ndarray):
        self.ranges, self.n = ranges, int(ranges[-1])
        at = np.minimum(np.searchsorted(term, p.words), max(len(term) - 1, 0))
        there = term[at] == p.words if len(term) else np.zeros(len(p.words), bool)
        size = np.where(there, first[np.minimum(at + 1, len(first) - 1)] - first[at], 0)
        self.first = np.concatenate([[0], np.cumsum(size)])
        own = np.repeat(np.arange(len(p.words)), size)
        self.postings = postings[np.repeat(first[at], size) + np.arange(len(own)) - self.first[own]].astype(np.int64)
        #: lists one after the other, each in order: so (list, position) is in order throughout
        self.sorted = own * (self.n + 1) + self.postings
        self.own = own

    def row(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ranges, at, "right") - 1

    def candidates(self, p: Phrases) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Runs of (window, position of its rarest term, order of its terms by rarity)."""
        counts = np.where(p.terms >= 0, (self.first[1:] - self.first[:-1])[p.terms], self.n + 1)
        live = np.flatnonzero((counts > 0).all(axis=1))
        order = np.argsort(counts[live], axis=1, kind="stable")
        rarest = p.terms[live, order[:, 0]]
        size = self.first[rarest + 1] - self.first[rarest]
        ends = np.cumsum(size)
        for lo in range(0, int(ends[-1]) if len(ends) else 0, CHUNK):
            k = np.arange(lo, min(lo + CHUNK, int(ends[-1])))
            w = np.searchsorted(ends, k, "right")
            yield live[w], self.postings[self.first[rarest[w]] + k - (ends[w] - size[w])], order[w]

    def phrases(self, p: Phrases, window: np.ndarray, at: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, start) of exact occurrences: starts that the shifted lists of all terms have."""
        start, row, length = at - order[:, 0], self.row(at), p.length[window]
        ok = (start >= self.ranges[row]) & (start + length <= self.ranges[row + 1])
        window, start, order = window[ok], start[ok], order[ok]
        for j in range(1, order.shape[1]):
            term = p.terms[window, order[:, j]]
            wanted = term * (self.n + 1) + start + order[:, j]
            ok = (term < 0) | (self.sorted[np.minimum(np.searchsorted(self.sorted, wanted), len(self.sorted) - 1)] == wanted)
            window, start, order = window[ok], start[ok], order[ok]
        return window, start

    def nearby(self, p: Phrases, window: np.ndarray, at: np.ndarray, slop: int) -> Iterator[tuple[int, int]]:
        """(row, window) where ``slop`` consecutive words hold all terms of the window."""
        row = self.row(at)
        low, high = np.maximum(at + 1 - slop, self.ranges[row]), np.minimum(at + slop, self.ranges[row + 1])
        ok = np.ones(len(at), bool)
        for j in range(p.terms.shape[1]):  # each term has a posting in reach
            term = np.where(p.terms[window, j] >= 0, p.terms[window, j], p.terms[window, 0])
            place = np.searchsorted(self.sorted, term * (self.n + 1) + low)
            ok &= self.sorted[np.minimum(place, len(self.sorted) - 1)] < term * (self.n + 1) + high
            ok &= place < len(self.sorted)
        for k in np.flatnonzero(ok):
            need = np.unique(p.terms[window[k]][p.terms[window[k]] >= 0])
            lists = [self.postings[np.searchsorted(self.sorted, t * (self.n + 1) + low[k]) : np.searchsorted(self.sorted, t * (self.n + 1) + high[k])] for t in need]
            if any(all(((x >= s) & (x < s + slop)).any() for x in lists) for s in range(int(at[k]) + 1 - slop, int(at[k]) + 1)):
                yield int(row[k]), int(window[k])


def _search(batches: Iterator[pa.RecordBatch], p: Phrases, slop: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            flat = lambda c, k=k: batch.column(c).slice(k, 1).flatten()
            number = lambda c: flat(c).to_numpy(zero_copy_only=False)
            ranges = number("first_word").astype(np.int64)
            n = len(ranges) - 1
            items, near, hits = [set() for _ in range(n)], [set() for _ in range(n)], [[] for _ in range(n)]
            if ranges[-1] and len(p.words):
                shard = Shard(p, ranges, number("term").view(np.uint64), number("first"), number("postings"))
                marks = np.zeros(shard.n + 1, np.int64)
                for window, at, order in shard.candidates(p):
                    found, start = shard.phrases(p, window, at, order)
                    np.add.at(marks, start, 1)
                    np.add.at(marks, start + p.length[found], -1)
                    for w, r in set(zip(found.tolist(), shard.row(start).tolist(), strict=True)):
                        items[r].update(p.of[w])
                    if slop:
                        for r, w in set(shard.nearby(p, window, at, slop)):
                            near[r].update(p.of[w])
                hit = np.flatnonzero(np.cumsum(marks[:-1]) > 0)
                for r, x in zip(shard.row(hit).tolist(), hit.tolist(), strict=True):
                    hits[r].append(x - int(ranges[r]))
            name = lambda x: [p.items[i] for i in sorted(x) if p.items[i] is not None]
            yield pa.RecordBatch.from_arrays(
                [pa.array([batch.column("shard")[k].as_py()] * n, pa.int64()), pa.array(np.arange(n), pa.int32()), flat("doc_id"), flat("digest"), pa.array(np.diff(ranges), pa.int64()), pa.array(hits, pa.list_(pa.int32())), pa.array(list(map(name, items)), pa.list_(pa.string())), pa.array(list(map(name, near)), pa.list_(pa.string()))],
                ["shard", "nth", "doc_id", "digest", "n_words", "hits", "items", "near"],
            )


def _blocks(benchmark: DataFrame, block_words: int) -> Iterator[tuple[list[str], list[str]]]:
    """The items in blocks of about ``block_words`` words; null texts and empty ones have no windows."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).dropDuplicates()
    words = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-int(words) // (6 * block_words)))
    for k in range(n):
        own = (rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)).toArrow().sort_by([("item_id", "ascending"), ("text", "ascending")])
        yield own["item_id"].to_pylist(), own["text"].to_pylist()


def search(index: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = SLOP, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per indexed document: shard, nth, doc_id, digest (of the text), n_words, hits (word positions), items, near.

    ``slop`` 0 leaves proximity out.  Items without an item_id are left out of
    ``items``, but their windows count as hits.  Repeated benchmark rows count
    once; null texts and those without words have no windows.  An empty
    benchmark gives no hits.
    """
    spark = index.sparkSession
    parts = []
    for items, texts in _blocks(benchmark, block_words):
        sent = spark.sparkContext.broadcast(Phrases(items, texts, window))
        parts.append(index.mapInArrow(lambda it, b=sent: _search(it, b.value, slop), FOUND))
    if len(parts) == 1:
        return parts[0]
    parts = [saved(x, "decontam-block") for x in parts]
    hits = parts[0]
    for x in parts[1:]:
        hits = hits.unionByName(x)
    together = [F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c) for c in ("hits", "items", "near")]
    flat = hits.where((F.size("hits") > 0) | (F.size("near") > 0)).groupBy("shard", "nth").agg(*together)
    out = parts[0].drop("hits", "items", "near").join(flat, ["shard", "nth"], "left")
    return out.select("shard", "nth", "doc_id", "digest", "n_words", *[F.coalesce(c, F.array().cast(t)).alias(c) for c, t in (("hits", "array<int>"), ("items", "array<string>"), ("near", "array<string>"))])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = SLOP, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``search`` in an index of ``docs``: one row per document, repeated ones each."""
    return search(positional_index(docs), benchmark, window, slop, block_words)


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no benchmark window occurs, all columns as they are.

    Null and empty texts have no words and stay; repeated rows share their fate.
    An empty table on either side drops nothing.
    """
    digest = unused(docs, "digest")
    hit = decontaminate(docs, benchmark, slop=0).where(F.size("hits") > 0).select(F.col("digest").alias(digest)).distinct()
    marked = docs.withColumn(digest, F.md5(F.coalesce("text", F.lit(""))))
    return marked.join(saved(hit, "decontam-hit"), digest, "left_anti").select(*docs.columns)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.array_sort(F.array_distinct("items"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("hits").cast("long").alias("n_hit"),
        F.size(names).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


ORACLE_SQL = r"""
WITH low AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[k:least(k + 9, len(w))], ' ') AS phrase
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM items WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM windows),
starts AS (
  SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM low, lengths WHERE len(w) >= n),
found AS (
  SELECT s.r, s.k, s.n, x.item
  FROM (SELECT r, k, n, array_to_string(w[k:k + n - 1], ' ') AS phrase FROM starts) s JOIN windows x ON x.n = s.n AND x.phrase = s.phrase),
hits AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS place FROM found) GROUP BY r),
named AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM found GROUP BY r)
SELECT l.doc_id, CAST(len(l.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(m.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(m.names, '')) AS items_sha256, h.n_hit IS NOT NULL AS contaminated
FROM low l LEFT JOIN hits h USING (r) LEFT JOIN named m USING (r)
"""
