"""Operator 8: language-model scores from a Brown class bigram model.

Tokens are the words of a text and one end.  Classes come from the exchange
algorithm, which moves a word to the class that raises the likelihood of the
class bigrams most:

1. the ``HEAD`` most frequent tokens move one at a time, in up to ``EXCHANGES``
   rounds, until few move;
2. every other token of the ``COMMON`` most frequent that occurs ``LEAST`` times
   or more moves once, from the open class of its shape to the class that gains
   most by it.  Spark counts the classes before and after each such word, and
   tasks work out the gains of the words they hold.

All other tokens, seen or not, stay in the open classes of their shapes.  A
token's probability is

    P(class | class before) * P(token | class)

with additive smoothing on both.  Each open class keeps room for one more,
unseen token.

Five passes read the texts: token counts, pair counts of the head, classes
around words, pair counts of classes, scores.  All training texts are counted.
What is broadcast or reaches the driver is bounded: counts and classes of
``COMMON`` tokens, pair counts of (HEAD + open classes) squared.  Counts of all
other tokens are joined to the documents' tokens by shuffle.  Tokens are told
apart by hashes of their bytes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabguard.llm.bytetext import SPACED, lowered_words, slices
from tabguard.llm.shared import saved, table

HEAD = 1_024
COMMON = 300_000
LEAST = 3
CLASSES = 64
EXCHANGES = 6
SMOOTH = 0.1
BEGIN = 0
OPEN = 11
END = np.uint64(10)

_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(token, row range): every row's lower-cased words, then its end.

    A token is 60 bits of hash and four bits of shape: by first byte digit,
    punctuation or else one of three lengths, and whether punctuation is last.
    """
    starts, ends, ranges, hashes = lowered_words(data, offsets, SPACED)
    rows = len(offsets) - 1
    out = np.full(len(hashes) + rows, END)
    if len(hashes):
        first, size = data[starts], ends - starts
        shape = np.where(_DIGIT[first], 0, np.where(_PUNCTUATION[first], 1, 2 + (size > 5) + (size > 10))) + 5 * _PUNCTUATION[data[ends - 1]]
        out[np.arange(len(hashes)) + np.repeat(np.arange(rows), np.diff(ranges))] = (hashes & ~np.uint64(15)) | shape.astype(np.uint64)
    return out, ranges + np.arange(rows + 1)


def held_out(ids: pa.Array, fold: int = 0, folds: int = 10) -> np.ndarray:
    """crc32 of doc_id as text mod ``folds`` is ``fold``; false for a null doc_id."""
    return np.array([x is not None and zlib.crc32(str(x).encode()) % folds == fold for x in ids.to_pylist()], bool)


def _grow(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([a[0], b[0]])
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], np.concatenate([a[1], b[1]])[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    return keys[first], (np.add.reduceat(n, first) if len(keys) else n)


def _training(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        keep = ~held_out(batch.column("doc_id"))
        for lo, hi, data, offsets in slices(batch.column("text")):
            h, ranges = tokens(data, offsets)
            use = np.repeat(keep[lo:hi], np.diff(ranges))
            yield h[use], np.concatenate([[0], np.cumsum(np.where(keep[lo:hi], np.diff(ranges), 0))])


def _counted(batches: Iterator[pa.RecordBatch], most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    empty = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    held, parts, size = empty, [], 0

    def merged():
        keys, n = np.concatenate([held[0], *[p[0] for p in parts]]), np.concatenate([held[1], *[p[1] for p in parts]])
        return _grow((keys, n), empty)

    def out(x):
        return pa.RecordBatch.from_arrays([pa.array(x[0].view(np.int64)), pa.array(x[1])], ["token", "n"])

    for h, _ in _training(batches):
        own = np.unique(h, return_counts=True)
        parts.append((own[0], own[1].astype(np.int64)))
        size += len(own[0])
        if size > most:
            held, parts, size = merged(), [], 0
            if len(held[0]) > most:
                yield out(held)
                held = empty
    yield out(merged())


class Model:
    """Counts of common tokens, classes of most of them, class bigrams, smoothing.

    Class 0 stands before a text, 1 to ``inner`` are classes of words, the rest
    are the open classes by shape.
    """

    def __init__(self, common: np.ndarray, count: np.ndarray, heads: int):
        order = np.argsort(common)
        self.common, self.count = common[order], count[order].astype(np.float64)
        self.emit = np.log10(self.count + SMOOTH)
        self.first = np.sort(np.lexsort((self.common, -self.count))[:heads])
        self.inner = max(1, min(CLASSES, len(self.first)))
        self.width = self.inner + 1 + OPEN
        self.of_common = np.zeros(len(self.common), np.int64)  # 0: no class of its own

    def at(self, h: np.ndarray) -> np.ndarray:
        """Places among the common tokens, -1 for others."""
        if not len(self.common):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.common, h), len(self.common) - 1)
        return np.where(self.common[at] == h, at, -1)

    def classes(self, h: np.ndarray, at: np.ndarray) -> np.ndarray:
        shape = self.inner + 1 + (h & np.uint64(15)).astype(np.int64)
        own = self.of_common[at] if len(self.of_common) else np.zeros(len(h), np.int64)
        return np.where((at >= 0) & (own > 0), own, shape)

    @property
    def head_width(self) -> int:
        return len(self.first) + OPEN + 1

    def head_ids(self, h: np.ndarray) -> np.ndarray:
        """1 to H for head words, H + 1 and up for open classes."""
        at = self.at(h)
        place = np.minimum(np.searchsorted(self.first, at), max(len(self.first) - 1, 0))
        known = self.first[place] == at if len(self.first) else np.zeros(len(h), bool)
        return np.where(known, place + 1, len(self.first) + 1 + (h & np.uint64(15)).astype(np.int64))

    def cluster(self, pairs: np.ndarray, n: np.ndarray) -> None:
        """Classes of the head, and the class bigrams where all other tokens are in open classes."""
        w = self.head_width
        own = exchange(pairs // w, pairs % w, n.astype(np.float64), len(self.first), w, CLASSES)
        self.of_common[self.first] = own[1 : len(self.first) + 1]
        self.grid = np.zeros((self.width, self.width))
        np.add.at(self.grid, (own[pairs // w], own[pairs % w]), n)

    def moves(self, at: np.ndarray, back: np.ndarray, ahead: np.ndarray) -> np.ndarray:
        """The class that each word, now in an open class, gains most by; of equal ones the smallest, its own class last."""
        f = lambda x: x * np.log(np.maximum(x, 1e-300))
        shape = self.inner + 1 + (self.common[at] & np.uint64(15)).astype(np.int64)
        i, inner = np.arange(len(at)), np.arange(1, self.inner + 1)
        candidates = np.concatenate([np.broadcast_to(inner, (len(at), self.inner)), shape[:, None]], 1)
        # the grid without the word: its neighbours' cells of its open class
        rows, cols = self.grid[candidates], self.grid.T[candidates]
        rows[i[:, None], np.arange(candidates.shape[1])[None, :], shape[:, None]] -= back[i[:, None], candidates]
        cols[i[:, None], np.arange(candidates.shape[1])[None, :], shape[:, None]] -= ahead[i[:, None], candidates]
        rows[:, -1] -= ahead
        cols[:, -1] -= back
        np.maximum(rows, 0, out=rows)
        np.maximum(cols, 0, out=cols)
        gain = (f(rows + ahead[:, None, :]) - f(rows)).sum(2) + (f(cols + back[:, None, :]) - f(cols)).sum(2)
        pick = lambda x: x[i[:, None], candidates]
        corner = np.take_along_axis(rows, candidates[:, :, None], 2)[:, :, 0]
        a, b = pick(ahead), pick(back)
        gain += f(corner + a + b) - f(corner + a) - f(corner + b) + f(corner)
        row_sum, col_sum = np.maximum(self.grid.sum(1)[candidates], 0), np.maximum(self.grid.sum(0)[candidates], 0)
        row_sum[:, -1] -= ahead.sum(1)
        col_sum[:, -1] -= back.sum(1)
        np.maximum(row_sum, 0, out=row_sum)
        np.maximum(col_sum, 0, out=col_sum)
        gain -= f(row_sum + ahead.sum(1)[:, None]) - f(row_sum) + f(col_sum + back.sum(1)[:, None]) - f(col_sum)
        return candidates[i, np.round(gain, 6).argmax(1)]

    def fit(self, pairs: np.ndarray, n: np.ndarray, open_count: np.ndarray, open_types: np.ndarray) -> None:
        """Smoothed logarithms from the class bigrams, and counts and kinds of the tokens that are not common by shape."""
        self.grid = np.zeros((self.width, self.width))
        self.grid.flat[pairs] = n
        with np.errstate(divide="ignore"):
            self.step = np.log10((self.grid + SMOOTH) / (self.grid.sum(1, keepdims=True) + SMOOTH * (self.width - 1)))
        own = self.classes(self.common, np.arange(len(self.common)))
        total, types = (np.bincount(own, weights=w, minlength=self.width).astype(float) for w in (self.count, np.ones(len(own))))
        total[self.inner + 1 :] += open_count
        types[self.inner + 1 :] += open_types + 1
        self.room = -np.log10(np.maximum(total + SMOOTH * types, SMOOTH))


def exchange(left: np.ndarray, right: np.ndarray, n: np.ndarray, heads: int, width: int, classes: int) -> np.ndarray:
    """A class for each id: 0 alone, heads in 1 to ``classes``, each open class alone.

    Starts from frequency ranks dealt to classes in turn.
    """
    own = np.zeros(width, np.int64)
    per = np.bincount(right, weights=n, minlength=width)
    rank = np.argsort(-per[1 : heads + 1], kind="stable")
    classes = max(1, min(classes, heads))
    own[1 + rank] = 1 + np.arange(heads) % classes
    own[heads + 1 :] = classes + 1 + np.arange(width - heads - 1)
    k = classes + 1 + (width - heads - 1)
    out_order, in_order = np.argsort(left, kind="stable"), np.argsort(right, kind="stable")
    out_at, in_at = np.searchsorted(left[out_order], np.arange(width + 1)), np.searchsorted(right[in_order], np.arange(width + 1))
    grid = np.zeros((k, k))
    np.add.at(grid, (own[left], own[right]), n)
    f = lambda x: x * np.log(np.maximum(x, 1e-300))
    inner = np.arange(1, classes + 1)
    for _ in range(EXCHANGES):
        moved = 0
        for word in 1 + rank:
            o, i = out_order[out_at[word] : out_at[word + 1]], in_order[in_at[word] : in_at[word + 1]]
            to, to_n, from_, from_n = right[o], n[o], left[i], n[i]
            self_n = to_n[to == word].sum()
            ahead = np.bincount(own[to[to != word]], weights=to_n[to != word], minlength=k)
            back = np.bincount(own[from_[from_ != word]], weights=from_n[from_ != word], minlength=k)
            old = own[word]
            grid[old] -= ahead
            grid[:, old] -= back
            grid[old, old] -= self_n
            np.maximum(grid, 0, out=grid)
            # gain of joining class c: new terms of row c, of column c and of the marginals
            rows, cols = grid[inner], grid[:, inner].T
            gain = (f(rows + ahead) - f(rows)).sum(1) + (f(cols + back) - f(cols)).sum(1)
            corner = grid[inner, inner]
            gain += f(corner + ahead[inner] + back[inner] + self_n) - f(corner + ahead[inner]) - f(corner + back[inner]) + f(corner)
            # the word's neighbours keep their places in the marginals, wherever it goes
            row_sum, col_sum = grid.sum(1)[inner] + back[inner], grid.sum(0)[inner] + ahead[inner]
            gain -= f(row_sum + ahead.sum() + self_n) - f(row_sum) + f(col_sum + back.sum() + self_n) - f(col_sum)
            new = inner[int(np.argmax(gain))] if gain.max() > gain[old - 1] + 1e-9 else old
            own[word] = new
            grid[new] += ahead
            grid[:, new] += back
            grid[new, new] += self_n
            moved += new != old
        if moved <= heads // 200:
            break
    return own


def _before(ids: np.ndarray, ranges: np.ndarray) -> np.ndarray:
    left = np.concatenate([[BEGIN], ids[:-1]]) if len(ids) else ids
    left[ranges[:-1][ranges[:-1] < len(left)]] = BEGIN
    return left


def _summed(parts: Iterator[np.ndarray], most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Occurrences as (pair, n), summed as far as ``most`` kinds go."""
    empty = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    held = empty
    for part in parts:
        pair, n = np.unique(part, return_counts=True)
        held = _grow(held, (pair, n.astype(np.int64)))
        if len(held[0]) > most:
            yield pa.RecordBatch.from_arrays([pa.array(held[0]), pa.array(held[1])], ["pair", "n"])
            held = empty
    yield pa.RecordBatch.from_arrays([pa.array(held[0]), pa.array(held[1])], ["pair", "n"])


def _head_pairs(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    def parts():
        for h, ranges in _training(batches):
            ids = model.head_ids(h)
            yield _before(ids, ranges) * model.head_width + ids

    return _summed(parts())


def _class_pairs(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    def parts():
        for h, ranges in _training(batches):
            own = model.classes(h, model.at(h))
            yield _before(own, ranges) * model.width + own

    return _summed(parts())


def _around(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """(pair, n): how often a class stands before (even) or after (odd) a common word without a class; not the word itself."""
    def parts():
        for h, ranges in _training(batches):
            at = model.at(h)
            own = model.classes(h, at)
            left = _before(own, ranges)
            wanted = (at >= 0) & (model.count[at] >= LEAST) & (model.of_common[at] == 0) if len(model.count) else at >= 0
            last = np.zeros(len(h), bool)
            last[ranges[1:][ranges[1:] > ranges[:-1]] - 1] = True
            same = np.zeros(len(h), bool)
            same[1:] = (at[1:] == at[:-1]) & ~last[:-1]
            before = wanted & ~same
            after = wanted[:-1] & ~last[:-1] & ~same[1:] if len(h) else wanted
            yield np.concatenate([(at[before] * 2) * model.width + left[before], (at[:-1][after] * 2 + 1) * model.width + own[1:][after]])

    return _summed(parts())


def _moved(batches: Iterator[pa.RecordBatch], model: Model, some: int = 200) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, cells, counts = batch.column("at").to_numpy(), batch.column("cells"), batch.column("counts")
        for lo in range(0, len(at), some):
            own = at[lo : lo + some]
            dense = np.zeros((len(own), 2 * model.width))
            part = cells.slice(lo, some)
            row = np.repeat(np.arange(len(own)), part.value_lengths().to_numpy())
            np.add.at(dense, (row, part.flatten().to_numpy()), counts.slice(lo, some).flatten().to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(model.moves(own, dense[:, : model.width], dense[:, model.width :]))], ["at", "class"])


SCORED = "doc_id long, row long, held_out boolean, n_tokens long, n_common long, common_log double, score_log double, tail array<long>"


def _scored(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    at = TaskContext.get().partitionId() << 33
    for batch in batches:
        out = held_out(batch.column("doc_id"))
        for lo, hi, data, offsets in slices(batch.column("text")):
            h, ranges = tokens(data, offsets)
            at_common = model.at(h)
            own = model.classes(h, at_common)
            before = _before(own, ranges)
            common = at_common >= 0
            row = np.repeat(np.arange(hi - lo), np.diff(ranges))
            emit = np.zeros(len(h))
            emit[common] = model.emit[at_common[common]]
            total = lambda x: np.bincount(row, weights=x, minlength=hi - lo)
            tail = np.bincount(row[~common], minlength=hi - lo)
            part = batch.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id").cast(pa.int64()),
                    pa.array(at + np.arange(hi - lo)),
                    pa.array(out[lo:hi]),
                    pa.array(np.diff(ranges)),
                    pa.array(total(common.astype(float)).astype(np.int64)),
                    pa.array(total(emit)),
                    pa.array(total(model.step[before, own] + model.room[own])),
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(tail)]).astype(np.int32)), pa.array(h[~common].view(np.int64))),
                ],
                ["doc_id", "row", "held_out", "n_tokens", "n_common", "common_log", "score_log", "tail"],
            )
            at += hi - lo


def _least_common(counts: DataFrame, most: int) -> int:
    """A count that at most ``most`` tokens reach, from a histogram of the counts' logarithms."""
    bins = counts.groupBy(F.floor(F.log2("n") * 16).alias("bin")).agg(F.count("*").alias("tokens"), F.min("n").alias("least")).collect()  # some hundred rows
    least, tokens = 1 << 62, 0
    for r in sorted(bins, key=lambda r: -r["bin"]):
        tokens += r["tokens"]
        if tokens > most:
            break
        least = r["least"]
    return least


def fitted(rows: DataFrame, head: int = HEAD, common: int = COMMON) -> tuple[Model, DataFrame]:
    """The model of (doc_id, text) rows, and the counts of all training tokens as (token, n)."""
    spark = rows.sparkSession
    counts = saved(rows.mapInArrow(_counted, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")), "lm-counts")
    least = _least_common(counts, common)
    often = counts.where(F.col("n") >= least).toPandas()  # at most ``common`` rows
    model = Model(often["token"].to_numpy(np.int64).view(np.uint64), often["n"].to_numpy(np.int64), head)

    def counted(f, known: Model) -> DataFrame:
        sent = spark.sparkContext.broadcast(known)
        return rows.mapInArrow(lambda it: f(it, sent.value), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))

    pairs = counted(_head_pairs, model).toPandas()
    model.cluster(pairs["pair"].to_numpy(np.int64), pairs["n"].to_numpy(np.int64))
    wide = F.lit(2 * model.width)
    around = counted(_around, model).select(F.expr(f"pair div {2 * model.width}").alias("at"), (F.col("pair") % wide).alias("cell"), "n")
    around = around.groupBy("at").agg(F.collect_list(F.struct("cell", "n")).alias("c")).select("at", F.col("c.cell").alias("cells"), F.col("c.n").alias("counts"))
    sent = spark.sparkContext.broadcast(model)
    moved = around.mapInArrow(lambda it: _moved(it, sent.value), "at long, class long").toPandas()  # at most ``common`` rows
    model.of_common[moved["at"].to_numpy(np.int64)] = np.where(moved["class"] <= model.inner, moved["class"], 0)
    pairs = counted(_class_pairs, model).toPandas()
    shapes = counts.where(F.col("n") < least).groupBy(F.col("token").bitwiseAND(15).alias("shape")).agg(F.sum("n").alias("n"), F.count("*").alias("types")).toPandas()
    opened, types = np.zeros(OPEN), np.zeros(OPEN)
    opened[shapes["shape"]], types[shapes["shape"]] = shapes["n"], shapes["types"]
    model.fit(pairs["pair"].to_numpy(np.int64), pairs["n"].to_numpy(np.int64), opened, types)
    return model, counts


def language_scores(docs: DataFrame, head: int = HEAD, common: int = COMMON) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for every document.

    Null texts count as empty and have one token, the end.  A null doc_id is
    never held out.  Repeated rows are each counted and scored.  Long texts are
    read whole.  Without training texts no token is known: N and V are 0, and
    scores are those of smoothing alone.  Columns other than doc_id and text are
    not looked at.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    model, counts = fitted(rows, head, common)
    all_n, types = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    sent = spark.sparkContext.broadcast(model)
    scored = saved(rows.mapInArrow(lambda it: _scored(it, sent.value), SCORED), "lm-scores")
    floor = float(np.log10(SMOOTH))
    tail = scored.select("row", F.explode("tail").alias("token")).groupBy("row", "token").agg(F.count("*").alias("times"))
    joined = tail.join(counts, "token").groupBy("row").agg(F.sum("times").alias("n_tail"), F.sum(F.col("times") * (F.log10(F.col("n") + F.lit(SMOOTH)) - F.lit(floor))).alias("tail_log"))
    rest = F.col("n_tokens") - F.col("n_common")
    emitted = F.col("common_log") + rest * F.lit(floor) + F.coalesce("tail_log", F.lit(0.0))
    room = float(np.log10(all_n + SMOOTH * (types + 1)))
    return scored.drop("tail").join(joined, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_common") + F.coalesce("n_tail", F.lit(0))).alias("n_known"),
        F.lit(int(all_n)).cast("long").alias("train_tokens"),
        (emitted - F.col("n_tokens") * F.lit(room)).alias("base_score"),
        (emitted + F.col("score_log")).alias("score"),
    )


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_scores(table(spark, sf_dir, "documents"))
