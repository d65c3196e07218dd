"""Operator 13: fill-in-the-middle documents, cut by an indexable skip list.

A text is a row of units, ``[A-Za-z]+|[^A-Za-z]``.  Its skip list has every unit
as a link of the bottom lane, and express lanes whose links each span several of
the lane below; a link carries how many units and how many code points it
spans.  A cut at a rank of units is found from the top lane down, by adding up
the widths passed, which gives the code points before it exactly.  Where the
cuts fall, and whether a text is transformed, follows from a digest of its
doc_id, so reruns and retries agree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabguard.llm.shared import table

# fixed values: what announces the parts
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: of 100 texts, how many stay plain, and how many of the others have their suffix first
PLAIN, SPM = 10, 20
SEED = "1"
#: a link of a lane is the start of one of the lane above once in so many
FAN = 16
_MIX = np.uint64(0x9E3779B97F4A7C15)


def unit_widths(text: str) -> np.ndarray:
    """The code points of each unit."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    letter = (codes | 32) - np.uint32(97) < 26
    starts = np.flatnonzero(~letter | np.concatenate([[True], ~letter[:-1]])) if len(codes) else np.zeros(0, int)
    return np.diff(starts, append=len(codes))


class SkipList:
    def __init__(self, widths: np.ndarray, fan: int = FAN):
        #: of each lane, bottom first: the units and code points of its links, and where these start in the lane below
        self.lanes = [(np.ones(len(widths), np.int64), widths.astype(np.int64), np.arange(len(widths)))]
        while len(self.lanes[-1][0]) > fan:
            units, points, _ = self.lanes[-1]
            dealt = (np.arange(len(units), dtype=np.uint64) + np.uint64(len(self.lanes))) * _MIX >> np.uint64(40)
            starts = np.flatnonzero((dealt % np.uint64(fan) == 0) | (np.arange(len(units)) == 0))
            if len(starts) == len(units):
                break
            self.lanes.append((np.add.reduceat(units, starts), np.add.reduceat(points, starts), starts))

    def before(self, rank: int) -> int:
        """The code points before the unit of this rank; all of them at the rank behind the last."""
        at = units = points = 0
        for n, width, below in reversed(self.lanes):
            while at < len(n) and units + n[at] <= rank:
                units, points, at = units + int(n[at]), points + int(width[at]), at + 1
            if at == len(n):
                break
            at = int(below[at])
        return points


def cut(doc_id: int | None, text: str, seed: str = SEED, plain: int = PLAIN, spm: int = SPM) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, prefix and middle code points, output)."""
    widths = unit_widths(text)
    n = len(widths)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    if not text or h3 % 100 >= 100 - plain or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    links = SkipList(widths)
    a, b = (links.before(r) for r in sorted((h1 % (n + 1), h2 % (n + 1))))
    before, inside, after = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm:
        return n, "spm", a, b - a, f"{SUFFIX}{after}{PREFIX}{before}{MIDDLE}{inside}"
    return n, "psm", a, b - a, f"{PREFIX}{before}{SUFFIX}{after}{MIDDLE}{inside}"


_SCHEMA = "doc_id long, text string, n long, form string, prefix_chars long, middle_chars long, output string"


def _cut(batches: Iterator[pa.RecordBatch], how: tuple[str, int, int]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column("doc_id"), batch.column("text")
        rows = [cut(i.as_py(), t.as_py() or "", *how) for i, t in zip(ids, texts, strict=True)]
        n, form, before, inside, output = zip(*rows, strict=True) if rows else [()] * 5
        own = [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(before, pa.int64()), pa.array(inside, pa.int64()), pa.array(output, batch.schema.field("text").type)]
        yield pa.RecordBatch.from_arrays([ids, texts, *own], ["doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output"])


def fill_in_middle(docs: DataFrame, seed: str = SEED, plain: int = PLAIN, spm: int = SPM) -> DataFrame:
    """(doc_id, text, n, form, prefix_chars, middle_chars, output) of every row.

    A null text counts as empty and gives an empty output; empty texts, texts
    that hold one of the three marks, and ``plain`` of 100 others stay as they
    are.  Texts of any length are cut whole.  Rows with the same doc_id and text
    are cut alike; rows without a doc_id are cut as if it were an empty text.
    Columns other than doc_id and text are not looked at.  An empty table has no
    rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(lambda it: _cut(it, (seed, plain, spm)), _SCHEMA)


def restored(form: Column, output: Column) -> Column:
    """The text that an output was made of: its parts stand between marks that no part holds."""
    between = lambda a, b: F.split_part(F.split_part(output, F.lit(a), F.lit(2)), F.lit(b), F.lit(1))
    inside = F.split_part(output, F.lit(MIDDLE), F.lit(2))
    psm = F.concat(between(PREFIX, SUFFIX), inside, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), inside, between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("form"), F.col("output")), 256).alias("restored_sha256"),
    )


ORACLE_SQL = """
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d
  FROM documents),
dealt AS (
  SELECT doc_id, text, u, CAST(len(u) AS BIGINT) AS n, CAST('0x' || substr(d, 1, 8) AS BIGINT) % (len(u) + 1) AS r1,
         CAST('0x' || substr(d, 9, 8) AS BIGINT) % (len(u) + 1) AS r2,
         CAST('0x' || substr(d, 17, 8) AS BIGINT) % 100 AS h3, CAST('0x' || substr(d, 25, 8) AS BIGINT) % 100 AS h4
  FROM units),
parts AS (
  SELECT doc_id, text, n,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 >= 90 THEN 'plain'
              WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form,
         array_to_string(u[1:least(r1, r2)], '') AS p, array_to_string(u[least(r1, r2) + 1:greatest(r1, r2)], '') AS m,
         array_to_string(u[greatest(r1, r2) + 1:], '') AS s
  FROM dealt)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE text END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""
