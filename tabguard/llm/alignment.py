"""Operator 12: how two tokenizers' tokens line up, by inverted bitmaps of pairs.

Each text is encoded by a byte-level BPE (A) and a piece BPE (B).  Where a token
of both ends at the same byte, a group ends and the two tokens are linked.  How
often a pair of ids is linked in the whole corpus is counted from an inverted
index: documents are numbered in blocks, and a pair's posting in a block is a
compressed bitmap of its documents for each binary digit of its multiplicity
(``pairbits``).  Sums over a pair's postings give its documents and links; then
the postings carry the pair's score back to the documents, a block at a time.

Both tokenizers end a token before every space that follows no white space, so
texts are cut there and what a stretch gives is remembered; words are encoded
once for each time they fall out of that memory.  A block ends at ``LINKS``
links or 65,536 documents, so a pair that every document holds has one posting
in each block, and a task holds one block.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabguard.llm.pairbits import counted, packed, planes
from tabguard.llm.shared import saved, split_join, table, total

BYTE_BPE, PIECE_BPE = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
LINKS, DOCS = 1 << 22, 1 << 16
#: stretches remembered in each of two generations, and the longest that are
MEMORY, WORD = 100_000, 64
#: rows of postings in a batch
ROWS = 20_000
# fixed values: how a byte-level BPE of this kind cuts texts before it merges, and the space of the pieces
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPACE = "▁"

_LOOSE, _CUT = re.compile(r"\s "), re.compile(r"(?<=\S)(?= )")


def stretches(text: str) -> list[str]:
    """The space and the text, cut before every space that follows no white space; each begins with a space."""
    whole = " " + text
    return _CUT.split(whole) if _LOOSE.search(whole) else [" " + w for w in text.split(" ")]


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes: printable ones for themselves, the others by 256 and up in their order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pair:
    """Both tokenizers, from the contents of their files, with the bytes of every token."""

    def __init__(self, byte_bpe: bytes, piece_bpe: bytes):
        import sentencepiece
        import tiktoken

        letters = _byte_letters()
        vocabulary = json.loads(byte_bpe)
        special = {t["content"] for t in vocabulary.get("added_tokens", [])}
        ranks = {bytes(letters[c] for c in t): i for t, i in vocabulary["model"]["vocab"].items() if t not in special}
        self.a = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.a_bytes = {i: t for t, i in ranks.items()}
        self.b = sentencepiece.SentencePieceProcessor(model_proto=piece_bpe)
        piece = lambda i: bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace(SPACE, " ").encode()
        self.b_bytes = [piece(i) for i in range(self.b.vocab_size())]
        self.sizes = [np.array([len(own[i]) if i in own else 0 for i in range(max(own) + 1)]) for own in (self.a_bytes, dict(enumerate(self.b_bytes)))]
        self.said = [np.array([f"{i}{c}" for i in range(len(n)) for c in (",", last)], object) for n, last in zip(self.sizes, "|;", strict=True)]
        self.space = self.b.piece_to_id(SPACE)
        self.old: dict[str, tuple | None] = {}
        self.new: dict[str, tuple | None] = {}

    def ids(self, cut: list[str]) -> list[tuple[list[int], list[int]]]:
        b = self.b.encode([s[1:] for s in cut], num_threads=1)  # it puts the space back
        return [(self.a.encode_ordinary(s), [self.space] if s == " " else own) for s, own in zip(cut, b, strict=True)]

    def aligned(self, cut: list[str]) -> list[tuple | None]:
        """Of each stretch (tokens of A, of B, groups, links as 64-bit numbers, groups as text); none where tokens do not give it back."""
        raw, made = [s.encode() for s in cut], self.ids(cut)
        of = lambda ids, known: b"".join([known[i] for i in ids])
        flat = lambda side: [i for m in made for i in m[side]]
        whole, known = b"".join(raw), (self.a_bytes, self.b_bytes)
        if any(of(flat(k), known[k]) != whole for k in (0, 1)):
            good = [all(of(m[k], known[k]) == r for k in (0, 1)) for m, r in zip(made, raw, strict=True)]
            kept = iter(self.aligned([s for s, g in zip(cut, good, strict=True) if g]) if any(good) else [])
            return [next(kept) if g else None for g in good]
        tokens, counts = [np.array(flat(k), np.int64) for k in (0, 1)], [np.array([len(m[k]) for m in made]) for k in (0, 1)]
        ends = [np.cumsum(size[t]) for size, t in zip(self.sizes, tokens, strict=True)]
        shared, *last = np.intersect1d(*ends, assume_unique=True, return_indices=True)
        group = [np.searchsorted(shared, e) for e in ends]  # both tokenizers end each stretch
        links = tokens[0][last[0]] << 16 | tokens[1][last[1]]
        # every token with what follows it: a comma, a bar behind the last of A, a semicolon behind the last of B
        said = [self.said[k][2 * t + (e == shared[g])] for k, (t, e, g) in enumerate(zip(tokens, ends, group, strict=True))]
        order = np.argsort(np.concatenate([2 * group[0], 2 * group[1] + 1]), kind="stable")
        said = np.concatenate(said)[order].tolist()
        stops = np.searchsorted(shared, np.cumsum([len(r) for r in raw])) + 1
        starts = np.concatenate([[0], stops[:-1]])
        out, at = [], 0
        for a, b, lo, hi in zip(counts[0].tolist(), counts[1].tolist(), starts.tolist(), stops.tolist(), strict=True):
            out.append((a, b, hi - lo, links[lo:hi].tobytes(), "".join(said[at : at + a + b])))
            at += a + b
        return out

    def remembered(self, texts: list[list[str]]) -> list[list[tuple | None]]:
        """What the stretches of each text give; those that are not remembered are encoded together."""
        fresh = {s: self.old.get(s, 0) for s in set().union(*texts) - self.new.keys()}
        unknown = [s for s, v in fresh.items() if v == 0]
        for lo in range(0, len(unknown), 4_096):
            part = unknown[lo : lo + 4_096]
            fresh.update(zip(part, self.aligned(part), strict=True))
        known = self.new
        out = [[known[s] if s in known else fresh[s] for s in own] for own in texts]
        for s, v in fresh.items():
            if len(s) <= WORD:
                if len(self.new) >= MEMORY:
                    self.old, self.new = self.new, {}
                self.new[s] = v
        return out


_ROWS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, block long, doc int, pair long, planes binary"
_TYPES = [pa.int64()] * 5 + [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
_NAMES = [f.split()[0] for f in _ROWS.split(", ")]


def _batch(columns: dict) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([columns[name] if name in columns else pa.nulls(n, t) for name, t in zip(_NAMES, _TYPES, strict=True)], _NAMES)


def _postings(block: int, entries: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    if not entries:
        return
    pair, times = (np.concatenate([e[i] for e in entries]) for i in (0, 1))
    pairs, offsets, data = packed(pair, np.repeat(np.arange(len(entries)), [len(e[0]) for e in entries]), times, len(entries))
    for lo in range(0, len(pairs), ROWS):
        own = offsets[lo : lo + ROWS + 1]
        body = pa.py_buffer(data[own[0] : own[-1]].tobytes())
        binary = pa.Array.from_buffers(pa.binary(), len(own) - 1, [None, pa.py_buffer((own - own[0]).astype(np.int32).tobytes()), body])
        yield _batch({"block": pa.array(np.full(len(own) - 1, block)), "pair": pa.array(pairs[lo : lo + ROWS]), "planes": binary})


def _encoded(batches: Iterator[pa.RecordBatch], files: tuple[bytes, bytes], links: int) -> Iterator[pa.RecordBatch]:
    pair, block = Pair(*files), TaskContext.get().partitionId() << 32
    entries, held = [], 0
    for batch in batches:
        ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
        for lo in range(0, len(ids), 200):
            cut = [stretches(t) if (t := v.as_py()) else [] for v in texts[lo : lo + 200]]
            for doc_id, found in zip(ids[lo : lo + 200], pair.remembered(cut), strict=True):
                if not found or None in found:
                    yield _batch({k: pa.array([v], t) for k, v, t in zip(_NAMES[:6], (doc_id, 0, 0, 0, 0, ""), _TYPES, strict=False)})
                    continue
                a, b, groups, linked, said = zip(*found, strict=True)
                pairs, times = np.unique(np.frombuffer(b"".join(linked), np.int64), return_counts=True)
                row = (doc_id, sum(a), sum(b), sum(groups), int(times.sum()), hashlib.sha256("".join(said)[:-1].encode()).hexdigest(), block, len(entries))
                yield _batch({k: pa.array([v], t) for k, v, t in zip(_NAMES[:8], row, _TYPES, strict=False)})
                entries.append((pairs, times))
                held += row[4]
                if held >= links or len(entries) == DOCS:
                    yield from _postings(block, entries)
                    entries, held, block = [], 0, block + 1
    yield from _postings(block, entries)


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return offsets, data


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if len(batch):
            docs, links = counted(*_buffers(batch.column("planes")))
            yield pa.RecordBatch.from_arrays([batch.column("pair"), pa.array(docs), pa.array(links)], ["pair", "docs", "links"])


def _scores(group: pa.Table) -> pa.Table:
    """Of each document of a block: the sum of its links' counts, and how many of them are the best of their B id."""
    total_, best_ = np.zeros(DOCS, np.int64), np.zeros(DOCS, np.int64)
    seen = np.zeros(DOCS, bool)
    for part in group.to_batches():
        if not len(part):
            continue
        links, best = part.column("links").to_numpy(), part.column("best").to_numpy(zero_copy_only=False)
        for row, digit, doc in planes(*_buffers(part.column("planes"))):
            seen[doc] = True
            np.add.at(total_, doc, links[row] << digit)
            np.add.at(best_, doc, best[row].astype(np.int64) << digit)
    doc = np.flatnonzero(seen)
    block = group.column("block")[0].as_py()
    return pa.table({"block": np.full(len(doc), block), "doc": doc.astype(np.int32), "n_best": best_[doc], "count_sum": total_[doc]})


@dataclass(frozen=True)
class Alignment:
    #: (doc_id, n_a, n_b, n_groups, n_links, groups_sha256, block, doc); block and doc are null without tokens
    documents: DataFrame
    #: (block, pair, planes)
    postings: DataFrame
    #: (pair, a, b, docs, links, best, n): documents and links of a pair, whether no other of its B id has more, and its postings
    pairs: DataFrame

    def scored(self) -> DataFrame:
        """The documents with ``n_best`` and ``count_sum``; zeros without tokens."""
        own = self.pairs.select("pair", "links", "best", "n")
        told = split_join(self.postings, own, "pair", "block", total(own)).select("block", "planes", "links", "best")
        scores = told.groupBy("block").applyInArrow(_scores, "block long, doc int, n_best long, count_sum long")
        out = self.documents.join(scores, ["block", "doc"], "left")
        return out.select(*[c for c in self.documents.columns if c not in ("block", "doc")], *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_best", "count_sum")])


def align(docs: DataFrame, byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE, links: int = LINKS) -> Alignment:
    """The alignment of every row's text under the two tokenizers of these files.

    Null and empty texts, and texts that the joined tokens of one tokenizer do
    not give back, have no tokens: zeros, and an empty text for the digest of
    their groups.  Texts of any length are encoded whole.  Repeated rows are
    documents of their own, and all count; rows without a doc_id too.  Pairs
    with the same count are all the best of their B id.  Columns other than
    doc_id and text are not looked at.  An empty table has no rows.
    """
    spark = docs.sparkSession
    files = []
    for path in (byte_bpe, piece_bpe):
        with open(path, "rb") as f:
            files.append(f.read())
    sent = spark.sparkContext.broadcast(tuple(files))  # two vocabularies, a few MB
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = saved(rows.mapInArrow(lambda it: _encoded(it, sent.value, links), _ROWS), "pair-postings")
    postings = found.where("pair IS NOT NULL").select("block", "pair", "planes")
    counts = postings.select("pair", "planes").mapInArrow(_counted, "pair long, docs long, links long")
    sums = counts.groupBy("pair").agg(F.sum("docs").alias("docs"), F.sum("links").alias("links"), F.count("*").alias("n"))
    named = sums.withColumns({"a": F.shiftright("pair", 16).cast("int"), "b": F.col("pair").bitwiseAND(0xFFFF).cast("int")})
    # a B id has at most as many pairs as A has ids
    best = named.withColumn("best", F.col("links") == F.max("links").over(W.partitionBy("b")))
    return Alignment(found.where("pair IS NULL").select(*_NAMES[:8]), postings, saved(best, "pairs"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = align(table(spark, sf_dir, "documents")).scored()
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
