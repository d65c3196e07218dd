"""Operator 1: main text of web pages by consensus paths of their host.

First pass: each page scores its containers by the plain text they hold, and
votes for their tag-class paths, with digits generalised.  Spark sums the votes
by host and path; the path with most votes is the host's, and so are up to
``PATHS`` that have ``CLOSE`` of its votes.  Second pass: the page's containers
on these paths are extracted again.  Where they hold less than ``ENOUGH`` of the
text of the page's own best container, that is extracted with them.

Menus, forms, comments and their like hold no article, but a form or a block that
has such a name and nearly all of the page's text is a wrapper of the layout: it
is read, and what lies in it is judged in its place.

Votes are summed before they are shuffled, so that a host with a third of all
pages costs no more than another.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabguard.llm.htmltree import Page
from tabguard.llm.shared import saved, table

CLOSE = 0.8
PATHS = 4
ENOUGH = 0.7


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total: dict[tuple[str, int], float] = {}
        for host, source in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            found = Page(source).containers() if source else []
            for score, e in found:
                share = score / found[0][0] if found[0][0] > 0 else 0.0
                if share > 0:
                    key = host, int.from_bytes(e.place, "big", signed=True)
                    total[key] = total.get(key, 0.0) + share
        keys = list(total)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()), pa.array([round(total[k] * 1e6) for k in keys], pa.int64())], ["host", "path", "votes"])


def main_text(source: str | None, paths: list[int] | None) -> tuple[str, str]:
    """(text, paths used) of one page, given its host's paths."""
    if not source:
        return "", ""
    page = Page(source)
    found = [e for _, e in page.containers()]
    if not found:
        return "", ""
    wanted = {p.to_bytes(8, "big", signed=True) for p in paths or []}
    agreed = [e for e in found if e.place in wanted]
    outer = page.outermost(agreed)
    if sum(e.good for e in outer) < ENOUGH * found[0].good:
        outer = page.outermost([*agreed, found[0]])
    return page.text_below({id(e) for e in outer}), " ".join(sorted({e.path for e in outer}))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [main_text(*x) for x in zip(batch.column("html").to_pylist(), batch.column("paths").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array([x[0] for x in out], pa.string()), pa.array([len(x[0]) for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string())],
            ["page_id", "url", "text", "n_chars", "path"],
        )


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars and the path used, for every row of ``pages``.

    Null and empty html, and pages without article text, give an empty text.
    Null or odd urls belong to the host without a name.  Repeated rows are each
    extracted.  Ties of votes go to the smaller digest of the path.  Pages of any
    length are read whole, in time and memory that grow with their length; an
    unfinished tag swallows the rest, as in browsers.  Columns other than
    page_id, url and html are not looked at.  An empty table has no rows.
    """
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), host.alias("host"), "html")
    votes = rows.select("host", "html").mapInArrow(_votes, "host string, path long, votes long").groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    ranked = votes.withColumn("place", F.row_number().over(W.partitionBy("host").orderBy(F.desc("votes"), "path"))).where(F.col("place") <= PATHS)
    close = ranked.groupBy("host").agg(F.max("votes").alias("most"), F.collect_list(F.struct("votes", "path")).alias("p"))  # PATHS at most
    agreed = close.select(F.col("host").alias("_host"), F.expr(f"transform(filter(p, x -> x.votes >= {CLOSE} * most), x -> x.path)").alias("paths"))
    agreed = saved(agreed, "page-paths")
    named = rows.join(agreed, rows["host"] == agreed["_host"], "left").select("page_id", "url", "html", "paths")
    return named.mapInArrow(_texts, "page_id long, url string, text string, n_chars long, path string")


def op1_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")
