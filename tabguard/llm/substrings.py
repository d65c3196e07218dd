"""Operator 5: exact removal of long repeated substrings by merged suffix runs.

Sorting every suffix would move the corpus some two hundred times over.  Here
each stretch of ``LENGTH`` bytes is assigned to the ``GRAM`` bytes in it with the
smallest hash, its anchor, so equal stretches have equal anchors at equal
places, and consecutive stretches mostly share one.  A span is the run of
stretches of one anchor:

1. anchors that occur once have no repeated stretch;
2. spans that occur twice or more are repeated throughout;
3. where an anchor occurs in different spans, the suffixes at the anchors are
   sorted: tasks sort runs, exchange them front-coded, and loser trees merge
   them.  The prefixes that neighbours have in common, which the merge knows,
   say which suffixes agree from the anchor on, for any number of bytes: a
   stretch that starts d bytes before its anchor is repeated where suffixes in
   a row agree in ``LENGTH - d`` bytes and two of them have the same d bytes
   before.

Equal spans are counted before that, so only one copy of each is sorted.  Where
an anchor has more than ``CROWD`` different spans, their stretches are counted
by 128-bit hash instead, dealt over ``SALTS`` by text, so that no task holds all
copies of a stretch.  Rows are known by numbers, anchors and spans by 64-bit
hashes, stretches in different spans by their bytes.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabguard.llm.bytetext import mix, prefix_hash, slices, span_hash
from tabguard.llm.shared import partitions, saved, shared_dir, split_join, table, total
from tabguard.llm.suffixsort import Run, encode_run, merge

LENGTH = 200
GRAM = 40
PLACE_BITS = 24
RUN = 10_000
GROUP = 10_000
CROWD = 2_000
SALTS = 64

ANCHORS = "anchor long, span long, key long, place long"


def anchored(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, first start, last start, anchor place, anchor hash, span hash) of all spans of a slice; places are in the slice."""
    n = len(data)
    none = (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    if n < LENGTH:
        return none
    h = prefix_hash(data)
    at = np.arange(n - GRAM + 1)
    grams = span_hash(h, at, at + GRAM)
    chosen = np.zeros(n - LENGTH + 1, np.int64)
    step, wide = 1 << 22, LENGTH - GRAM + 1
    for lo in range(0, len(chosen), step):
        hi = min(lo + step, len(chosen))
        part = grams[lo : hi + wide - 1]
        low = (part & ~np.uint64((1 << PLACE_BITS) - 1)) | np.arange(len(part), dtype=np.uint64)
        size = 1
        while size * 2 <= wide:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        rest = wide - size
        low = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
        chosen[lo:hi] = (low & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64) + lo
    row = np.searchsorted(offsets, np.arange(len(chosen)), "right") - 1
    valid = np.arange(len(chosen)) + LENGTH <= offsets[row + 1]
    place = np.flatnonzero(valid)
    if not len(place):
        return none
    own, of = chosen[place], row[place]
    new = np.ones(len(place), bool)
    new[1:] = (own[1:] != own[:-1]) | (of[1:] != of[:-1])
    first = place[new]
    last = place[np.append(np.flatnonzero(new)[1:] - 1, len(place) - 1)]
    return of[new], first, last, own[new], grams[own[new]], mix(span_hash(h, first, last + LENGTH))


def _anchors(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
    """The anchors of all spans, and with ``whole`` the spans: first start, stretches - 1 and anchor place in one number."""
    for batch in batches:
        key = batch.column("key").to_numpy()
        for lo, _, data, offsets in slices(batch.column("text"), 1_000_000):
            row, first, last, at, anchor, span = anchored(data, offsets)
            names, columns = ["anchor"], [pa.array(anchor.view(np.int64))]
            if whole:
                place = (first - offsets[row]) << 16 | (at - first) << 8 | (last - first)  # both below 256
                names += ["span", "key", "place"]
                columns += [pa.array(span.view(np.int64)), pa.array(key[lo + row]), pa.array(place)]
            yield pa.RecordBatch.from_arrays(columns, names)


TYPES = ("<i8", "<i4", "<u1", "<u1")


STRETCHES = "high long, low long, key long, start int, asked boolean"


def _stretches(batches: Iterator[pa.RecordBatch], most: int = 50_000) -> Iterator[pa.RecordBatch]:
    """Every stretch of the spans by 128 bits of hash."""
    held: list[tuple[bytes, int, int, bool]] = []

    def out() -> pa.RecordBatch:
        digest = np.frombuffer(b"".join(h[0] for h in held), "<i8").reshape(-1, 2)
        columns = [pa.array(digest[:, 0]), pa.array(digest[:, 1]), *[pa.array([h[i] for h in held], t) for i, t in ((1, pa.int64()), (2, pa.int32()), (3, pa.bool_()))]]
        held.clear()
        return pa.RecordBatch.from_arrays(columns, ["high", "low", "key", "start", "asked"])

    for batch in batches:
        for key, text, spans in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            data = text.encode()
            for s in spans:
                first = s["place"] >> 16
                for k in range(first, first + (s["place"] & 255) + 1):
                    held.append((hashlib.blake2b(data[k : k + LENGTH], digest_size=16).digest(), key, k, s["asked"]))
                if len(held) >= most:
                    yield out()
    if held:
        yield out()


def _counted(stretches: DataFrame) -> DataFrame:
    """(key, start) of the asked stretches that occur twice or more.

    Counts are summed over the salts and joined back by salt: of a stretch in
    many texts a task has the rows of one salt.
    """
    stretches = saved(stretches.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")), "substrings-stretches")
    parts = saved(stretches.groupBy("high", "low", "salt").agg(F.count("*").alias("n")), "substrings-counts")
    often = parts.groupBy("high", "low").agg(F.sum("n").alias("n")).where("n > 1").select("high", "low")
    salted = parts.select("high", "low", "salt").join(often, ["high", "low"], "left_semi")
    return stretches.where("asked").join(salted, ["high", "low", "salt"], "left_semi").select("key", "start")


def _runs(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Sorted runs of the spans' suffixes, cut by bucket."""
    held: list[tuple[int, bytes, bytes, int, int, int, bool]] = []

    def out() -> pa.RecordBatch:
        wide = LENGTH
        rows = np.frombuffer(b"".join(h[1].ljust(wide, b"\0") for h in held), np.uint8).reshape(-1, wide)
        seed = np.array([h[0] for h in held], np.int64).view(np.uint64)
        bucket = (mix(seed) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((rows.view(f"S{wide}").ravel(), bucket))
        key, first = np.array([h[3] for h in held], np.int64), np.array([h[4] for h in held])
        n, asked = np.array([h[5] for h in held]), np.array([h[6] for h in held])
        found = []
        edges = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=buckets))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            own = order[a:b]
            # a stretch ends at most LENGTH bytes on, so the padding is never compared
            found.append((int(bucket[own[0]]), encode_run(rows[own], ((key[own], TYPES[0]), (first[own], TYPES[1]), (n[own], TYPES[2]), (asked[own], TYPES[3])), [held[i][2] for i in own])))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.binary())], ["bucket", "run"])

    for batch in batches:
        for key, text, spans in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            data = text.encode()
            for s in spans:
                first, n = s["place"] >> 16, (s["place"] & 255) + 1
                anchor = first + (s["place"] >> 8 & 255)
                held.append((s["anchor"], data[anchor : first + n - 1 + LENGTH], data[first:anchor], key, first, n, s["asked"]))
                if len(held) >= RUN:
                    yield out()
    if held:
        yield out()


def _repeats(group: list[tuple], shared: list[int]) -> Iterator[tuple[int, int]]:
    """(key, start) of asked stretches that two entries of one anchor share.

    ``shared`` is the prefix that each entry's suffix has in common with that of
    the entry before; of the bytes from the anchor on nothing else is looked at.
    """
    for d in range(max(len(before) for _, before, *_ in group) + 1):
        seen: dict[tuple[int, bytes], list[tuple[int, int, int]]] = {}
        row = 0
        for (_, before, key, first, n, asked), common in zip(group, shared, strict=True):
            row += common < LENGTH - d
            nth = len(before) - d
            if 0 <= nth < n:
                seen.setdefault((row, before[nth:]), []).append((key, first + nth, asked))
        for own in seen.values():
            if len(own) > 1:
                yield from ((k, s) for k, s, asked in own if asked)


def _merged(key: tuple, group: pa.Table) -> pa.Table:
    found: list[tuple[int, int]] = []
    held: list[tuple] = []
    common: list[int] = []
    for shared, entry in merge([Run(b, TYPES) for b in group["run"].to_pylist()]):
        if held and shared < GRAM:
            if len(held) > 1:
                found += _repeats(held, common)
            held, common = [], []
        held.append(entry)
        common.append(shared)
    if len(held) > 1:
        found += _repeats(held, common)
    return pa.table({"key": pa.array([f[0] for f in found], pa.int64()), "start": pa.array([f[1] for f in found], pa.int32())})


CUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _cut(batches: Iterator[pa.RecordBatch], texts: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, holes in zip(batch.column("text").to_pylist(), batch.column("holes").to_pylist(), strict=True):
            data, at, kept, runs = text.encode(), 0, [], 0
            end = -1
            for a, b in sorted((h["a"], h["b"]) for h in holes or []):
                if a > end:
                    kept.append(data[at:a])
                    runs += 1
                end = max(end, b)
                at = end
            kept = b"".join([*kept, data[at:]])
            out.append((len(data), len(data) - len(kept), runs, hashlib.sha256(kept).hexdigest(), kept if texts else None))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *[pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))]],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
        )


def by_key(rows: DataFrame) -> DataFrame:
    """The rows as a table bucketed by ``key``, below the shared folder: joins on it need not shuffle the texts."""
    spark = rows.sparkSession
    name = f"tabguard_texts_{uuid.uuid4().hex}"
    rows.write.bucketBy(partitions(spark), "key").format("parquet").option("compression", "zstd").option("path", f"{shared_dir(spark)}/tabguard/{name}").saveAsTable(name)
    return spark.table(name)


def holes(rows: DataFrame) -> DataFrame:
    """For (key, text) rows: (key, holes) of the texts with repeated stretches."""
    texts = rows.select("key", "text")
    often = saved(texts.mapInArrow(lambda it: _anchors(it, False), "anchor long").groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"), "substrings-often")
    spans = total(often)
    twice = saved(split_join(texts.mapInArrow(lambda it: _anchors(it, True), ANCHORS), often, "anchor", "key", spans).drop("n"), "substrings-twice")
    forms = saved(twice.groupBy("anchor", "span").agg(F.count("*").alias("n"), F.min(F.struct("key", "place")).alias("at")), "substrings-forms")
    whole = split_join(twice, forms.where("n > 1").select("anchor", "span", "n"), ["anchor", "span"], "key", spans).select("key", "place")
    varied = saved(forms.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"), "substrings-varied")
    named = forms.select("anchor", "span", F.col("n").alias("copies"), "at")
    open_forms = saved(split_join(named, varied, "anchor", "span", total(varied)).withColumn("crowded", F.col("n") > CROWD), "substrings-open")
    few = open_forms.where("not crowded")
    buckets = max(1, -(-few.count() // GROUP))
    one = F.struct("anchor", F.col("at.place").alias("place"), (F.col("copies") == 1).alias("asked"))
    asked = lambda forms: forms.groupBy(F.col("at.key").alias("key")).agg(F.collect_list(one).alias("spans"))
    holding = lambda forms: texts.join(asked(forms).hint("merge"), "key")
    single = holding(few).mapInArrow(lambda it: _runs(it, buckets), "bucket int, run binary").groupBy("bucket").applyInArrow(_merged, "key long, start int")
    crowd = open_forms.where("crowded")
    if not crowd.isEmpty():
        single = single.unionByName(_counted(holding(crowd).mapInArrow(_stretches, STRETCHES)))
    first = F.shiftright("place", 16).cast("int")
    every = whole.select("key", first.alias("a"), (first + F.col("place").bitwiseAND(255).cast("int") + LENGTH).alias("b")).unionByName(single.select("key", F.col("start").alias("a"), (F.col("start") + LENGTH).alias("b")))
    return saved(every.groupBy("key").agg(F.collect_set(F.struct("a", "b")).alias("holes")), "substrings-holes")


def deduplicated(docs: DataFrame, texts: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and (with ``texts``) the kept bytes of every row.

    Null texts count as empty.  Texts shorter than ``LENGTH`` bytes have nothing
    to remove.  Repeated rows are copies of each other, so all of a long enough
    text is removed from each.  Long texts are read whole.  Columns other than
    doc_id and text are not looked at.  An empty table has no rows.
    """
    text = F.coalesce("text", F.lit(""))
    # numbers of rows, fixed by writing them
    rows = by_key(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.monotonically_increasing_id().alias("key")))
    out = rows.join(holes(rows).hint("merge"), "key", "left").select("doc_id", "text", "holes")
    return out.mapInArrow(lambda it: _cut(it, texts), CUT)


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents"), texts=False).drop("kept")
