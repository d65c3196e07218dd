"""Operator 3: near-duplicates by DartMinHash signatures and a banded join.

A document is a set of weighted elements, its shingles of five words.  Each
element and weight region is a board at which darts are thrown by hash: they
arrive at ranks of a Poisson process and fall evenly over the region.  A dart
that lies below the element's weight counts; each of the signature's
coordinates keeps the earliest dart that falls to it.  Two documents agree in a
coordinate with the probability of their weighted Jaccard similarity, and a
document of n elements needs about ``k log k`` darts, not ``n k`` hashes.

Signatures are cut into bands, documents that share a band meet, and pairs are
then checked on the whole shingle sets.  In a band, members are checked against
the one that meets most others, instead of each other; classes are the
components of the links found.  Where this leaves different classes in one
bucket, all pairs of different classes are checked: in a small bucket as rows
of a join, in a large one tile against tile, so that its sets are sent once to
each pair of tiles and no pair of keys becomes a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabguard.llm.bytetext import LETTERS, lowered_words, mix, shingles, slices, uniform
from tabguard.llm.components import components
from tabguard.llm.shared import saved, split_join, table, total, unused

WIDTH = 5
SIMILARITY = 0.8
BANDS = 25
ROWS = 5
PAIRWISE = 24
COUNTED = True
TILE = 2_048
TILE_SHINGLES = 2_000_000
#: shingles of up to so many sets of a tile are counted pair by pair, others by a matrix product
RARE = 16


def elements(hashes: np.ndarray, ranges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes by row: (row, hash, how often)."""
    row = np.repeat(np.arange(len(ranges) - 1), np.diff(ranges))
    order = np.lexsort((hashes, row))
    row, hashes = row[order], hashes[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    first = np.flatnonzero(new)
    return row[first], hashes[first], np.diff(np.append(first, len(row)))


def dart_signatures(row: np.ndarray, element: np.ndarray, weight: np.ndarray, rows: int, k: int) -> np.ndarray:
    """Signatures of ``rows`` weighted sets as a rows x k array of dart ids; a set without elements gets zeros.

    Weight regions are [0, 1), [1, 2), [2, 4) ... of each element.
    """
    out = np.zeros((rows, k), np.uint64)
    total = np.bincount(row, weights=weight, minlength=rows)
    reach = np.where(total > 0, k * (np.log(k) + 2.5) / np.maximum(total, 1e-300), 0.0)
    open_rows = total > 0
    while open_rows.any():
        use = open_rows[row]
        best = np.full(rows * k, np.inf)
        ids = np.zeros(rows * k, np.uint64)
        low, region = 0.0, 0
        while True:
            high = 1.0 if region == 0 else low * 2
            live = np.flatnonzero(use & (weight > low))
            if not len(live):
                break
            _throw(row[live], element[live], weight[live], low, high, region, reach, best, ids, k)
            low, region = high, region + 1
        best = best.reshape(rows, k)
        full = open_rows & np.isfinite(best).all(axis=1)
        out[full] = ids.reshape(rows, k)[full]
        open_rows = open_rows & ~full
        reach = reach * 2
    return out


def _throw(row, element, weight, low, high, region, reach, best, ids, k) -> None:
    """Darts of one weight region, the n-th of every element at a time, as long as they are in reach."""
    base = mix(element + np.uint64((region + 1) * 0x9FB21C651E98DF25 % (1 << 64)))
    rank, nth = np.zeros(len(row)), 0
    while len(row):
        nth += 1
        dart = mix(base + np.uint64(nth * 0xC2B2AE3D27D4EB4F % (1 << 64)))
        rank = rank - np.log(uniform(dart)) / (high - low)
        inside = rank <= reach[row]
        row, weight, base, rank, dart = row[inside], weight[inside], base[inside], rank[inside], dart[inside]
        place = mix(dart ^ np.uint64(0x5851F42D4C957F2D))
        counts = low + uniform(place) * (high - low) <= weight
        slot = row[counts] * k + (mix(place) % np.uint64(k)).astype(np.int64)[counts]
        at, dart_id = rank[counts], dart[counts]
        np.minimum.at(best, slot, at)
        won = best[slot] == at
        ids[slot[won]] = dart_id[won]


SIGNED = "digest string, doc_id long, row long, bands array<long>"


def _sign(batches: Iterator[pa.RecordBatch], width: int, bands: int, rows: int, counted: bool) -> Iterator[pa.RecordBatch]:
    at = TaskContext.get().partitionId() << 33
    for batch in batches:
        for lo, hi, data, offsets in slices(batch.column("text")):
            _, _, ranges, hashes = lowered_words(data, offsets, LETTERS)
            row, element, often = elements(*shingles(hashes, ranges, width))
            sign = dart_signatures(row, element, often.astype(float) if counted else np.ones(len(row)), hi - lo, bands * rows)
            acc = np.zeros((hi - lo, bands), np.uint64) + np.arange(bands, dtype=np.uint64)
            for j in range(rows):
                acc = mix(acc * np.uint64(0x9FB21C651E98DF25) + sign[:, j::rows])
            n = np.bincount(row, minlength=hi - lo)
            part = batch.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays([part.column("digest"), part.column("doc_id"), pa.array(at + np.arange(hi - lo)), _lists(np.where(n > 0, bands, 0), acc[n > 0].ravel().view(np.int64))], ["digest", "doc_id", "row", "bands"])
            at += hi - lo


def _lists(sizes: np.ndarray, flat: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat))


def _sets(batches: Iterator[pa.RecordBatch], width: int, counted: bool) -> Iterator[pa.RecordBatch]:
    """Shingle sets; with ``counted`` the copies of a shingle are elements of their own."""
    for batch in batches:
        for lo, hi, data, offsets in slices(batch.column("text")):
            _, _, ranges, hashes = lowered_words(data, offsets, LETTERS)
            row, element, often = elements(*shingles(hashes, ranges, width))
            nth = np.repeat(np.arange(len(row)), often if counted else 1)
            copy = np.arange(len(nth)) - np.concatenate([[0], np.cumsum(often)])[nth] if counted else np.zeros(len(nth), np.int64)
            kept = mix(element[nth] + copy.astype(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.slice(lo, hi - lo).column("key"), _lists(np.bincount(row[nth], minlength=hi - lo), kept)], ["key", "shingles"])


def _linked(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets reach ``similarity``; b may be in many."""
    often = saved(pairs.groupBy("b").agg(F.count("*").alias("n")), "neardup-often")
    one = pairs.join(sets.select(F.col("key").alias("a"), F.col("shingles").alias("sa")), "a")
    held = saved(often.join(sets.select(F.col("key").alias("b"), F.col("shingles").alias("sb")), "b"), "neardup-held")
    both = split_join(one, held, "b", "a", total(often))
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where(common >= F.lit(similarity) * (F.size("sa") + F.size("sb") - common) - 1e-9).select("a", "b")


def _members(once: DataFrame) -> DataFrame:
    """(band, key, score, n) of bands that n > 1 keys share.

    The score is the number of keys a key meets over its bands: of the members
    of a bucket, the one nearest to all others has most.
    """
    flat = once.select("key", F.explode("bands").alias("band"))
    shared = saved(flat.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "neardup-shared")
    met = saved(split_join(flat, shared, "band", "key", total(shared)), "neardup-met")
    return met.join(met.groupBy("key").agg(F.sum("n").alias("score")), "key").select("band", "key", "score", "n")


def _ordered(a: str, b: str) -> Column:
    return F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).alias("p")


def _stars(members: DataFrame) -> DataFrame:
    """(a, b): each key with the first of each of its buckets, by score, then key; a is never b's first."""
    first = saved(members.groupBy("band").agg(F.max(F.struct("score", "key"))["key"].alias("b"), F.max("n").alias("n")), "neardup-first")
    led = split_join(members.select("band", F.col("key").alias("a")), first, "band", "a", total(first))
    return led.where("a <> b").select("a", "b").distinct()


def _across(members: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs of keys in different classes that meet in a bucket of up to ``PAIRWISE`` keys."""
    few = members.where(F.col("n") <= PAIRWISE).join(classes, "key", "left").select("band", "key", F.coalesce("component", "key").alias("component"))
    mixed = few.groupBy("band").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("band")
    few = few.join(mixed, "band")
    other = few.select("band", F.col("key").alias("other"), F.col("component").alias("c"))
    return few.join(other, "band").where("component <> c AND key < other").select(_ordered("key", "other")).distinct().select("p.*")


def _tiled(members: DataFrame, classes: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) that join the classes of every bucket of more than ``PAIRWISE`` keys.

    A bucket that is more than one tile has tiles of its largest class, which
    are not compared with each other, and tiles of all other keys.
    """
    named = members.where(F.col("n") > PAIRWISE).join(classes, "key", "left").select("band", "key", F.coalesce("component", "key").alias("component"))
    sized = named.join(sets.select("key", F.size("shingles").alias("size")), "key")
    per = sized.groupBy("band", "component").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    whole = per.groupBy("band").agg(F.count("*").alias("classes"), F.sum("n").alias("n"), F.sum("size").alias("size"), F.max(F.struct("n", "component", "size")).alias("f"))
    tiles = lambda n, size: F.ceil(F.greatest(n / F.lit(TILE), size / F.lit(TILE_SHINGLES))).cast("int")
    one = tiles(F.col("n"), F.col("size")) == 1
    cut = whole.where("classes > 1").select(
        "band",
        F.col("f.component").alias("largest"),
        F.when(one, 0).otherwise(tiles(F.col("f.n"), F.col("f.size"))).alias("k"),
        F.when(one, 1).otherwise(tiles(F.col("n") - F.col("f.n"), F.col("size") - F.col("f.size"))).alias("l"),
    )
    first = (F.col("k") > 0) & (F.col("component") == F.col("largest"))
    by = F.xxhash64("key")
    dealt = named.join(cut, "band").withColumn("tile", F.when(first, F.pmod(by, "k")).otherwise(F.col("k") + F.pmod(by, "l")).cast("int"))
    dealt = dealt.select("band", "key", "component", "tile", F.explode(F.sequence(F.when(first, F.col("k")).otherwise(0), F.col("k") + F.col("l") - 1)).alias("other"))
    dealt = dealt.select("key", "component", "tile", "band", F.least("tile", "other").alias("one"), F.greatest("tile", "other").alias("two"))
    return dealt.join(sets, "key").groupBy("band", "one", "two").applyInArrow(lambda _, group: _compared(group, similarity), "a long, b long")


def _common(row: np.ndarray, element: np.ndarray, rows: int) -> np.ndarray:
    """How many elements each two rows share, above the diagonal; (row, element) are distinct."""
    order = np.lexsort((row, element))
    row, element = row[order], element[order]
    first = np.flatnonzero(np.diff(element, prepend=element[:1] - 1)) if len(element) else np.zeros(0, int)
    size = np.diff(np.append(first, len(element)))
    out = np.zeros((rows, rows), np.float32)
    for n in range(2, RARE + 1):
        own = row[first[size == n][:, None] + np.arange(n)]
        for i in range(n if len(own) else 0):
            for j in range(i + 1, n):
                np.add.at(out, (own[:, i], own[:, j]), 1)
    many = size > RARE
    column = np.repeat(np.where(many, np.cumsum(many) - 1, -1), size)
    for lo in range(0, int(many.sum()), 4_096):
        part = np.zeros((rows, 4_096), np.float32)
        use = (column >= lo) & (column < lo + 4_096)
        part[row[use], column[use] - lo] = 1
        out += part @ part.T
    return out


def _compared(group: pa.Table, similarity: float) -> pa.Table:
    """Of the pairs of one tile, or of two tiles, that reach ``similarity``: enough to join all classes that they join."""
    group = group.combine_chunks()
    keys, tile = group["key"].to_pylist(), group["tile"].to_numpy()
    label = np.unique(group["component"].to_pylist(), return_inverse=True)[1]
    found: list[tuple[int, int]] = []
    if label.any():
        lists = group["shingles"].combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        size = lists.value_lengths().to_numpy()
        row, element, _ = elements(lists.flatten().to_numpy().astype(np.int64), np.concatenate([[0], np.cumsum(size)]))
        common = _common(row, element, len(keys))
        across = (tile != tile[0]).any()
        for i in range(len(keys) - 1):
            own = common[i, i + 1 :]
            near = i + 1 + np.flatnonzero(own >= similarity * (size[i] + size[i + 1 :] - own) - 1e-9)
            if across:
                near = near[tile[near] != tile[i]]
            near = near[label[near] != label[i]]
            while len(near):
                found.append((min(keys[i], keys[near[0]]), max(keys[i], keys[near[0]])))
                label[label == label[near[0]]] = label[i]
                near = near[label[near] != label[i]]
    return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})


def row_id() -> Column:
    """doc_id as text, empty for null: a text of its own for each row but repeated ones, together with the digest."""
    return F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))


def _classes(links: DataFrame, further: DataFrame, classes: DataFrame) -> DataFrame:
    """The classes once more links are known: those between roots are joined, and keys follow their roots."""
    root = lambda c: classes.select(F.col("key").alias(c), F.col("component").alias(f"_{c}"))
    between = further.join(root("a"), "a", "left").join(root("b"), "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
    upper = components(between)
    moved = classes.join(upper.select(F.col("key").alias("component"), F.col("component").alias("_up")), "component", "left")
    moved = moved.select("key", F.coalesce("_up", "component").alias("component"))
    return saved(moved.unionByName(upper.join(classes, "key", "left_anti")), "neardup-classes")


def near_duplicates(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, counted: bool = COUNTED) -> DataFrame:
    """(digest, doc_id, component) of every row: rows of one component are one class.

    ``digest`` is that of the text, ``component`` a number that says nothing
    else and may change from run to run; the classes do not.
    Words are runs of letters, digits and non-ASCII characters with A-Z in
    lower case.  A shingle weighs as often as it occurs; without ``counted`` it
    weighs 1.  Texts of fewer than ``width`` words, but not none, are one
    shingle; null and empty texts, and any without words, are classes by equal
    text (null counts as empty).  Repeated rows fall into one class.  Long texts
    are read whole.  Other columns are not looked at.  An empty table has no rows.
    """
    text = F.coalesce("text", F.lit(""))
    rows_in = docs.select(F.md5(text).alias("digest"), row_id().alias("id"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    signed = saved(rows_in.mapInArrow(lambda it: _sign(it, width, bands, rows, counted), SIGNED), "neardup-signed")
    # from here on a text is known by the number of its first row
    once = signed.groupBy("digest").agg(F.min("row").alias("key"), F.min(row_id()).alias("id"), F.first("bands").alias("bands"), F.count("*").alias("n"))
    once = saved(once, "neardup-once")
    members = saved(_members(once), "neardup-members")
    # one row of each text that meets another; the members are a share of the corpus, so both sides are shuffled
    wanted = members.select("key").distinct().join(once.select("key", "digest", "id"), "key").hint("merge")
    texts = rows_in.select("digest", "id", "text").join(wanted, ["digest", "id"]).dropDuplicates(["digest", "id"]).select("key", "text")
    sets = saved(texts.mapInArrow(lambda it: _sets(it, width, counted), "key long, shingles array<long>"), "neardup-sets")
    tried = saved(_stars(members), "neardup-tried")
    links = saved(_linked(tried, sets, similarity), "neardup-links")
    classes = components(links)
    known = tried.select(_ordered("a", "b")).select("p.*")
    pairs = saved(_across(members, classes).join(known, ["a", "b"], "left_anti"), "neardup-pairs")
    further = saved(_linked(pairs, sets, similarity).unionByName(_tiled(members, classes, sets, similarity)), "neardup-links")
    classes = _classes(links, further, classes)
    named = once.select("digest", "key", "n").join(classes, "key", "left").select("digest", "n", F.coalesce("component", "key").alias("component"))
    named = saved(named, "neardup-named")
    return split_join(signed.select("digest", "doc_id"), named, "digest", "doc_id", total(named)).select("digest", "doc_id", "component")


def class_ids(found: DataFrame) -> DataFrame:
    """(doc_id, class_id): the smallest doc_id of the row's class."""
    found = saved(found, "neardup-found")
    least = saved(found.groupBy("component").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n")), "neardup-least")
    return split_join(found, least, "component", "doc_id", total(least)).select("doc_id", "class_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each class, that of the smallest doc_id (then the smallest digest).

    Columns stay as they are, whatever their names.  A class whose doc_ids are
    all null keeps one row of the smallest digest.  Rows that agree in doc_id
    and text are one row.  Null, empty and wordless texts are classes by equal
    text, so one row of each stays.  An empty table has no rows.
    """
    found = near_duplicates(docs)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest"))
    key, row = unused(docs, "digest"), unused(docs, "row_id")
    stay = found.groupBy("component").agg(first.alias("f")).select(F.col("f.digest").alias(key), F.coalesce(F.col("f.doc_id").cast("string"), F.lit("")).alias(row))
    marked = docs.withColumns({key: F.md5(F.coalesce("text", F.lit(""))), row: row_id()})
    return marked.join(saved(stay, "neardup-stay"), [key, row], "left_semi").dropDuplicates([key, row]).drop(key, row)


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_ids(near_duplicates(table(spark, sf_dir, "documents")))
