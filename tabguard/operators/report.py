"""Aggregations over findings."""

from __future__ import annotations

import re
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabguard.issues import ERROR, WARNING
from tabguard.sources.scratch import kept
from tabguard.sources.tables import with_row_numbers

# fixed values: the name space of run ids, and what levels are called
RUN_NAMESPACE = uuid.UUID("3c7f9a1e-8a3f-4ad6-9e6e-2a8b7c8e3a4e")
LEVEL_LABELS = {
    "L1": "L1 - Completeness",
    "L2": "L2 - Consistency",
    "CL": "CL - Code lists",
    "DPM": "DPM - Data types",
    "CROSS": "CROSS - Across tables",
    "SYSTEM": "SYSTEM - Technical",
    "DQ": "DQ - Data quality",
}
ISSUE_KEY = ("rule_id", "template", "row", "field_code", "severity")


def _count(n: str | None) -> Column:
    """Of findings, or of findings counted before in a column ``n``."""
    return F.count("*") if n is None else F.coalesce(F.sum(n), F.lit(0)).cast("long")


def _count_if(condition: Column, n: str | None) -> Column:
    return F.count_if(condition) if n is None else F.coalesce(F.sum(F.when(condition, F.col(n))), F.lit(0)).cast("long")


def totals(issues: DataFrame, n: str | None = None) -> DataFrame:
    """total, errors and warnings; other severities count in the total alone.  ``n`` names counts, as of ``sinks.RunSummary``."""
    return issues.agg(_count(n).alias("total"), _count_if(F.col("severity") == ERROR, n).alias("errors"), _count_if(F.col("severity") == WARNING, n).alias("warnings"))


def counts_by(issues: DataFrame, dims: Sequence[str] = ("template", "rule_type", "rule_level"), n: str | None = None) -> DataFrame:
    """(dimension, value, n) of several independent counts, in one pass by grouping sets."""
    groups = issues.groupingSets([[F.col(d)] for d in dims], *[F.col(d) for d in dims]).agg(_count(n).alias("_n"), *[F.grouping(d).alias(f"_{d}") for d in dims])
    name = F.coalesce(*[F.when(F.col(f"_{d}") == 0, F.lit(d)) for d in dims])
    value = F.coalesce(*[F.when(F.col(f"_{d}") == 0, F.col(d)) for d in dims])
    return groups.select(name.alias("dimension"), value.alias("value"), F.col("_n").alias("n"))


def severity_matrix(issues: DataFrame, dim: str) -> DataFrame:
    """Errors and warnings side by side for each value of ``dim``."""
    wide = issues.groupBy(dim).pivot("severity", [ERROR, WARNING]).count()
    return wide.select(F.col(dim).alias("value"), F.coalesce(ERROR, F.lit(0)).alias("errors"), F.coalesce(WARNING, F.lit(0)).alias("warnings"))


def severity_histogram(issues: DataFrame, n: str | None = None) -> DataFrame:
    return issues.groupBy("severity").agg(_count(n).alias("n"))


def _detail_order(ties: Sequence[str]) -> list:
    return [(F.col("severity") != ERROR).cast("int"), "template", F.coalesce("row", F.lit(0)), "rule_id", *ties]


def numbered(issues: DataFrame, ties: Sequence[str] = ("field_code", "value")) -> DataFrame:
    """Errors first, then table, row and rule, with ``seq`` from 1.

    Rows are ordered by ranges and numbered within each range; the sizes of the
    ranges before give the rest.  No window covers the whole table.
    """
    spark = issues.sparkSession
    ranges = issues.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *_detail_order(ties))
    ordered = kept(ranges.withColumn("_range", F.spark_partition_id()), "numbered")
    sizes = ordered.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # one row a range
    own = F.row_number().over(W.partitionBy("_range").orderBy(*_detail_order(ties)))
    return ordered.join(F.broadcast(sizes.select("_range", before.alias("_before"))), "_range").withColumn("seq", own + F.col("_before")).drop("_range", "_before")


def top_findings(issues: DataFrame, n: int = 10, ties: Sequence[str] = ("field_code", "value")) -> DataFrame:
    return issues.orderBy(*_detail_order(ties)).limit(n)


def status(issues: DataFrame, n: str | None = None) -> DataFrame:
    """One row: the delivery's state, and whether the gate fails."""
    state = F.when(F.col("errors") > 0, "errors").when(F.col("total") > 0, "warnings").otherwise("clean")
    return totals(issues, n).select(state.alias("status"), (F.col("errors") > 0).alias("failed"))


def labelled(df: DataFrame, column: str, labels: Mapping[str, str] = LEVEL_LABELS, name: str = "label") -> DataFrame:
    """Display names; unknown codes keep theirs."""
    pairs = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    return df.withColumn(name, F.coalesce(pairs[F.col(column)], F.col(column)))


def coverage(rules: DataFrame, issues: DataFrame) -> DataFrame:
    """Every rule with its number of findings."""
    found = issues.groupBy("rule_id").agg(F.count("*").alias("n"))
    return rules.join(found, "rule_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def run_id(input_path: str, started_at: str) -> str:
    """The same for the same input and start."""
    return str(uuid.uuid5(RUN_NAMESPACE, f"{input_path}|{started_at}"))


def manifest(
    issues: DataFrame, tables: Sequence[str], catalog_version: str, rule_count: int, input_path: str = "", source_type: str = "", input_hash: str = "",
    started_at: str = "", finished_at: str = "", de_annex: bool = False, n: str | None = None,
) -> DataFrame:
    """One row that records a run, fields and keys in order.

    Times are the caller's; no clock is read.  The run's id follows from its
    input and start.
    """
    by = issues.groupBy("severity").agg(_count(n).alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("severity", "n")))).alias("by_severity"), F.coalesce(F.sum("n"), F.lit(0)).alias("count"))
    names = F.array(*map(F.lit, sorted(tables))) if tables else F.array().cast("array<string>")
    return by.select(
        F.struct(F.lit(de_annex).alias("de_annex"), F.lit(rule_count).alias("rule_count"), F.lit(catalog_version).alias("version")).alias("catalog"),
        F.lit(finished_at).alias("finished_at"),
        F.struct(F.lit(input_hash).alias("hash"), F.lit(input_path).alias("path"), F.lit(source_type).alias("source_type")).alias("input"),
        F.struct("by_severity", "count").alias("issues"),
        F.lit(run_id(input_path, started_at)).alias("run_id"),
        F.lit(started_at).alias("started_at"),
        names.alias("templates_loaded"),
    )


def _digested(df: DataFrame, text: Column, count: str) -> DataFrame:
    """(``count``, digest) of all rows' texts, in any order: the sums of two halves of 64 bits of their hashes.

    A half is read as two numbers of 32 bits, which are summed as longs within
    each partition and as decimals over these.
    """
    digits = lambda at: F.sum(F.conv(F.substring("_hash", at, 8), 16, 10).cast("long")).alias(f"_{at}")
    parts = df.select(F.sha2(text, 256).alias("_hash"), F.spark_partition_id().alias("_part")).groupBy("_part").agg(F.count("*").alias("_n"), *[digits(at) for at in (1, 9, 17, 25)])
    part = lambda at: F.coalesce(F.sum(F.col(f"_{at}").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
    half = lambda at: (part(at) * F.lit(1 << 32) + part(at + 8)).cast("decimal(38,0)").cast("string")
    return parts.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias(count), F.concat(half(1), F.lit(":"), half(17)).alias("digest"))


def _framed(c: Column) -> Column:
    """A cell with its length before it, so that neighbours cannot run together; null has none."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def fingerprint(df: DataFrame) -> DataFrame:
    """(n, digest): the same for the same rows in any order; repeated rows count, null is no text."""
    return _digested(df, F.concat(*[_framed(F.col(f"`{c}`")) for c in df.columns]), "n")


def _known_as(path: str, name: Column | None) -> Column:
    return name if name is not None else F.element_at(F.split("path", re.escape(path.rstrip("/").split(":", 1)[-1].lstrip("/")) + "/", 2), -1)


def file_fingerprint(spark: SparkSession, path: str, name: Column | None = None) -> DataFrame:
    """(files, digest) over the names and contents of all files below a path, in any order.

    ``name`` is what a file is known by, as an expression of ``path``; by default
    what follows the given path.  No files, no digest but 0:0.  A file is read as
    one row; ``range_fingerprints`` takes files of any size.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return _digested(files, F.concat(_framed(_known_as(path, name)), F.sha2("content", 256)), "files")


def range_fingerprints(spark: SparkSession, path: str, name: Column | None = None, lines: int = 100_000) -> DataFrame:
    """(file, range, bytes, digest) of the text files below a path: one row for each ``lines`` lines of a file, numbered from 0.

    Files are read in splits, so their size does not matter; a line's place in
    its file is that of its split and what the splits before hold, as in
    ``tables.with_row_numbers``.  Lines count with their number, so that two that
    change places change the digest.  ``bytes`` are those of the lines, without
    what ends them.
    """
    read = with_row_numbers(spark.read.option("recursiveFileLookup", "true").text(path).withColumn("path", F.col("_metadata.file_path")), "_line", 0, by_file=True)
    own = read.select(_known_as(path, name).alias("file"), F.floor(F.col("_line") / lines).cast("long").alias("range"), "value", F.sha2(F.concat(F.col("_line").cast("string"), F.lit(":"), F.col("value")), 256).alias("_hash"))
    digits = lambda at: F.sum(F.conv(F.substring("_hash", at, 8), 16, 10).cast("long")).cast("string")
    return own.groupBy("file", "range").agg(F.sum(F.octet_length("value")).alias("bytes"), F.concat_ws(":", *[digits(at) for at in (1, 9, 17, 25)]).alias("digest"))


def changed_ranges(before: DataFrame, after: DataFrame) -> DataFrame:
    """(file, range, change) where two tables of ``range_fingerprints`` differ: changed, added or removed."""
    b = after.select("file", "range", F.col("digest").alias("_after"))
    both = before.select("file", "range", F.col("digest").alias("_before")).join(b, ["file", "range"], "full")
    change = F.when(F.col("_before").isNull(), "added").when(F.col("_after").isNull(), "removed").otherwise("changed")
    return both.where(~F.col("_before").eqNullSafe(F.col("_after"))).select("file", "range", change.alias("change"))


def issue_diff(expected: DataFrame, actual: DataFrame, key: Sequence[str] = ISSUE_KEY) -> DataFrame:
    """Keys on one side only, with ``side``, as often as they are more there.

    Each side counts its keys with its sign; one aggregate of both sides leaves
    what does not cancel out.
    """
    signed = lambda df, sign: df.select(*key, F.lit(sign).alias("_sign"))
    left = signed(expected, 1).unionByName(signed(actual, -1)).groupBy(*key).agg(F.sum("_sign").alias("_sign")).where("_sign <> 0")
    more = F.sequence(F.lit(1), F.abs("_sign"))
    return left.select(*key, F.when(F.col("_sign") > 0, "expected").otherwise("actual").alias("side"), F.explode(more).alias("_nth")).drop("_nth")
