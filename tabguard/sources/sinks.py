"""Writing findings and run manifests, and whole runs that are visible once they are complete."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabguard.issues import ISSUE_COLUMNS, ISSUE_DDL
from tabguard.operators import report

#: what a run is counted by while it is written, and how many combinations of these are told apart
COUNTED = ("rule_id", "template", "rule_type", "rule_level", "severity")
COMBINATIONS = 50_000


def write_issues(issues: DataFrame, path: str, stamp: bool = False, fmt: str = "parquet") -> None:
    """The fixed columns in their order, partitioned by rule level; the clock is read only here."""
    out = issues.select(*ISSUE_COLUMNS)
    if stamp:
        out = out.withColumn("timestamp", F.current_timestamp())
    out.write.partitionBy("rule_level").format(fmt).mode("errorifexists").save(path)


def read_issues(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_issues`` wrote, with its columns; no findings are an empty table, and an empty level is an empty text again."""
    return spark.read.schema(ISSUE_DDL).parquet(path).withColumn("rule_level", F.coalesce("rule_level", F.lit(""))).select(*ISSUE_COLUMNS)


def manifest_json(manifest: DataFrame) -> DataFrame:
    """One line of JSON with its keys in order: same input, same bytes."""
    return manifest.select(F.to_json(F.struct(*sorted(manifest.columns))).alias("value"))


def write_manifest(manifest: DataFrame, path: str) -> None:
    manifest_json(manifest).coalesce(1).write.mode("errorifexists").text(path)  # one row


@dataclass(frozen=True)
class RunSummary:
    """Findings of a run by rule, table, type, level and severity, with their number ``n``: what all reports but lists need.

    ``report.totals``, ``counts_by``, ``severity_histogram``, ``status`` and
    ``manifest`` take ``counts`` with ``n="n"``.
    """

    counts: DataFrame


def write_observed(issues: DataFrame, path: str, stamp: bool = False) -> RunSummary:
    """Write the findings and count them on the way: one job, in which the checks run once.

    The counts are a sketch of frequent items, which counts exactly while it has
    room for all combinations that occur; these are bounded by rules times tables.
    If it had to let go of any, its sum falls short of the number of findings,
    and the counts are taken from what was written.
    """
    spark = issues.sparkSession
    seen = Observation()
    key = F.to_json(F.array(*[F.coalesce(c, F.lit("")) for c in COUNTED]))
    # aggregates of a key that is a column of its own
    told = issues.select(*ISSUE_COLUMNS).withColumn("key of finding", key)
    told = told.observe(seen, F.count("*").alias("n"), F.expr(f"approx_top_k(`key of finding`, {COMBINATIONS}, {4 * COMBINATIONS})").alias("counts"))
    write_issues(told, path, stamp)
    found = seen.get
    counts = [(*json.loads(r["item"]), r["count"]) for r in found["counts"]]
    schema = ", ".join(f"{c} string" for c in COUNTED) + ", n long"
    if sum(c[-1] for c in counts) != found["n"]:
        return RunSummary(read_issues(spark, path).groupBy(*COUNTED).agg(F.count("*").alias("n")))
    return RunSummary(spark.createDataFrame(counts, schema))


# ---- runs that are whole or not there ------------------------------------------


def commit_run(issues: DataFrame, base: str, run_id: str, **about) -> RunSummary:
    """Write a run's findings below ``base`` and make them visible by one record, which holds its manifest.

    Findings are staged in a folder of this attempt.  Only when they are all
    there is a record written that names the attempt; readers look at records
    alone.  A run that fails leaves no record, so nothing of it is seen; a rerun
    with the same id adds a record, and the latest counts.  ``about`` is passed
    to ``report.manifest``.
    """
    spark = issues.sparkSession
    attempt = f"{base.rstrip('/')}/staged/{run_id}/{uuid.uuid4().hex}"
    summary = write_observed(issues, attempt)
    manifest = manifest_json(report.manifest(summary.counts, **about, n="n"))
    turn = F.lit(len(_records(spark, base, run_id)) + 1)
    record = manifest.select(F.to_json(F.struct(F.lit(run_id).alias("run_id"), turn.alias("turn"), F.lit(attempt).alias("attempt"), F.col("value").alias("manifest"))).alias("value"))
    record.coalesce(1).write.text(f"{base.rstrip('/')}/records/{run_id}/{uuid.uuid4().hex}")  # one row, one file, put in place by a rename
    return summary


_RECORD = "run_id string, turn int, attempt string, manifest string"


def _records(spark: SparkSession, base: str, run_id: str | None = None) -> list:
    """The latest record of each run, or all of one."""
    place = f"{base.rstrip('/')}/records"
    root = spark._jvm.org.apache.hadoop.fs.Path(place)
    if not root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root):
        return []
    records = spark.read.schema(_RECORD).option("recursiveFileLookup", "true").json(place)
    if run_id is not None:
        return records.where(F.col("run_id") == run_id).collect()
    latest = F.row_number().over(W.partitionBy("run_id").orderBy(F.desc("turn"), "attempt"))
    return records.withColumn("_latest", latest).where("_latest = 1").drop("_latest").collect()  # a row a run


def committed(spark: SparkSession, base: str, run_id: str | None = None) -> DataFrame:
    """Findings of the runs that were committed, of each its latest attempt, with ``run_id``."""
    chosen = [r for r in _records(spark, base) if run_id is None or r["run_id"] == run_id]
    parts = [read_issues(spark, r["attempt"]).withColumn("run_id", F.lit(r["run_id"])) for r in chosen]
    if not parts:
        raise FileNotFoundError(f"no committed run below {base}")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def manifests(spark: SparkSession, base: str) -> DataFrame:
    """(run_id, manifest) of the runs that were committed."""
    return spark.createDataFrame([(r["run_id"], r["manifest"]) for r in _records(spark, base)], "run_id string, manifest string")
