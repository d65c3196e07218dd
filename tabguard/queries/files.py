"""Queries of sources, catalogs, sinks and contracts, over files that Spark writes from the tables."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabguard.operators import checks as C
from tabguard.operators import report as R
from tabguard.plans.validation import validate
from tabguard.queries.rows import PRIORITIES
from tabguard.queries.views import ORDERS_SQL, dirty_orders, miss, table
from tabguard.queries.wide import LATER, RUN, RUN_ID, digest_sql, run_findings
from tabguard.sources import catalog, sinks, tables
from tabguard.sources.scratch import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f

    return keep


def _delivered(spark: SparkSession, d: str) -> str:
    """A delivery of two tables in three folders of text files."""
    base = scratch_path(spark, "delivery")
    rows = dirty_orders(spark, d).select(F.col("id").cast("string").alias("0010"), F.col("amount").alias("20"), F.col("category").alias("c0030"))
    out = lambda df, name: df.write.option("sep", ";").option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{base}/{name}.csv")
    out(rows.where("`0010` % 2 = 0"), "B02.00_TypeA")
    out(rows.where("`0010` % 2 = 1").drop("c0030"), "B02.00 TypeA")
    out(rows, "B03.00")
    rows.limit(0).select(F.lit("").alias("value")).coalesce(1).write.text(f"{base}/B04.00.csv")  # an empty file
    return base


_TEXT = "CASE WHEN amount IN ('', 'None', 'nan') THEN NULL ELSE amount END"


@query("s01_read_delimited", f"SELECT CAST(id AS STRING) AS c0010, {_TEXT} AS c0020, category AS c0030 FROM {ORDERS_SQL} t")
def read_delimited(spark, d):
    path = f"{_delivered(spark, d)}/B03.00.csv"
    return tables.read_delimited(spark, path, tables.header_of(spark, path))


@query(
    "s02_read_directory",
    f"SELECT 'B02.00_TypeA' AS table_key, CAST(id AS STRING) AS c0010, {_TEXT} AS c0020, CASE WHEN id % 2 = 0 THEN category END AS c0030 FROM {ORDERS_SQL} t UNION ALL SELECT 'B03.00', CAST(id AS STRING), {_TEXT}, category FROM {ORDERS_SQL} t",
)
def read_directory(spark, d):
    found = tables.read_directory(spark, _delivered(spark, d))
    a, b = (found[k].select(F.lit(k).alias("table_key"), "c0010", "c0020", "c0030") for k in ("B02.00_TypeA", "B03.00"))
    return a.unionByName(b)


_LONG = "id % 97 = 0"
_LINE = "CAST(id AS STRING) || ';\"a;' || CAST(cust AS STRING) || '\"'"


def _with_long_lines(spark: SparkSession, d: str) -> str:
    """A delivery in which some lines of one table have a cell too many; separators in quotes are none."""
    base = _delivered(spark, d)
    rows = dirty_orders(spark, d).selectExpr(f"CASE WHEN {_LONG} THEN {_LINE} || ';EXTRA' ELSE {_LINE} END AS value")
    rows.withColumnRenamed("value", "0010;0020").write.option("header", True).option("quote", "\u0000").option("emptyValue", "").csv(f"{base}/B06.00.csv", sep="\u0001")
    return base


@query("s01_malformed_lines", f"SELECT {_LINE} || ';EXTRA' AS text, 3 AS cells, 2 AS expected, true AS numbered FROM {ORDERS_SQL} t WHERE {_LONG}")
def malformed_lines(spark, d):
    """The lines of a table that are too long, with their place."""
    path = f"{_with_long_lines(spark, d)}/B06.00.csv"
    files = spark.read.text(path).select(F.col("_metadata.file_path").alias("p")).distinct().collect()
    return tables.malformed_lines(spark, {r["p"]: 2 for r in files}).select("text", "cells", "expected", (F.col("line") > 1).alias("numbered"))


@query("s02_malformed_left_out", f"SELECT 'B02.00_TypeA' AS table_key, count(*) AS n FROM {ORDERS_SQL} t UNION ALL SELECT 'B03.00', count(*) FROM {ORDERS_SQL} t")
def malformed_left_out(spark, d):
    """Whole tables alone are delivered: one with lines too long is left out with a warning."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        found = tables.read_directory(spark, _with_long_lines(spark, d))
    counts = [df.agg(F.lit(k).alias("table_key"), F.count("*").alias("n")) for k, df in sorted(found.items())]
    return reduce(DataFrame.unionByName, counts)


@query("s03_normalised_names", "SELECT CAST(c_custkey AS BIGINT) AS c0010, c_name AS c0010_1, c_mktsegment AS other FROM customer")
def normalised(spark, d):
    df = table(spark, d, "customer").select(F.col("c_custkey").cast("long"), "c_name", "c_mktsegment")
    return df.toDF(*tables.normalised_names(["0010", " 10 ", "other"]))


@query("s04_resolve_column", "SELECT c_custkey % 7 AS k, count(*) AS n, min(c_mktsegment) AS first FROM customer GROUP BY 1")
def resolved(spark, d):
    df = table(spark, d, "customer").select(F.col("c_custkey").alias("c0010"), F.col("c_mktsegment").alias("0020"))
    key, segment = (tables.resolve_column(df, c) for c in ("10", "c0020"))
    return df.groupBy((F.col(key) % 7).alias("k")).agg(F.count("*").alias("n"), F.min(segment).alias("first"))


@query("s05_family", "SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'B02.00_A' ELSE 'B02.00_B' END AS table_key, count(*) AS n FROM orders GROUP BY 1")
def family(spark, d):
    orders = table(spark, d, "orders")
    given = {"B02.00_B": orders.where("o_orderkey % 2 = 1"), "B02.00_A": orders.where("o_orderkey % 2 = 0"), "B03.00": orders}
    out = [given[k].agg(F.lit(k).alias("table_key"), F.count("*").alias("n")) for k in tables.family(given, "B02.00")]
    return out[0].unionByName(out[1])


def _pack(spark: SparkSession, d: str) -> DataFrame:
    """A rule pack whose rules, lists and values come from the tables."""
    segments = table(spark, d, "customer").select("c_mktsegment").distinct()
    rules = segments.agg(F.array_sort(F.collect_list(F.struct(
        F.concat(F.lit("seg_"), F.lower("c_mktsegment")).alias("rule_id"), F.lit("B01.00").alias("template"), F.col("c_mktsegment").alias("field_code"),
        F.when(F.col("c_mktsegment") < "C", F.lit("priority")).alias("codelist"), (F.col("c_mktsegment") > "M").alias("de_only")))).alias("rules"))
    orders = table(spark, d, "orders").select("o_orderpriority").distinct()
    lists = orders.agg(F.array_sort(F.collect_list("o_orderpriority")).alias("a"), F.array_sort(F.collect_list(F.when(F.col("o_orderpriority") < "3", F.col("o_orderpriority")))).alias("b"))
    made = rules.join(lists).select(
        F.struct(F.lit("1.0").alias("version")).alias("metadata"), "rules",
        F.create_map(F.lit("priority"), "a", F.lit("DE_priority"), "b").alias("codelists"),
        F.create_map(F.lit("B01.00;MACHINERY"), F.lit("priority")).alias("field_codelist_map"),
    )
    path = scratch_path(spark, "pack")
    made.select(F.to_json(F.struct("*"))).write.text(path)
    return catalog.read_pack(spark, path)


_SEGMENTS = "(SELECT DISTINCT c_mktsegment AS s FROM customer)"


@query("s06_rule_pack", f"SELECT 'seg_' || lower(s) AS rule_id, 'B01.00' AS template, s AS field_code, 'ERROR' AS severity, s > 'M' AS de_only, true AS enabled FROM {_SEGMENTS} q")
def rule_pack(spark, d):
    return catalog.rules_of(_pack(spark, d)).select("rule_id", "template", "field_code", "severity", "de_only", "enabled")


@query("s07_expected_schema", f"SELECT 'B01.00' AS \"table\", s AS field_code, lower(s) AS label, 'String' AS data_type, s < 'C' AS mandatory FROM {_SEGMENTS} q")
def expected(spark, d):
    segments = table(spark, d, "customer").select("c_mktsegment").distinct()
    old = F.struct(F.when(F.col("c_mktsegment") >= "C", F.col("c_mktsegment")).alias("code"), F.when(F.col("c_mktsegment") < "C", F.col("c_mktsegment")).alias("field_code"), F.lower("c_mktsegment").alias("label"), F.lit("String").alias("data_type"), F.when(F.col("c_mktsegment") < "C", F.lit(True)).alias("mandatory"))
    path = scratch_path(spark, "schema")
    segments.agg(F.create_map(F.lit("B01.00"), F.collect_list(old)).alias("templates")).select(F.to_json(F.struct("*"))).write.text(path)
    return catalog.expected_schema(spark, path).select("table", "field_code", "label", "data_type", "mandatory")


@query("s08_overlay", "SELECT 'priority' AS codelist, o_orderpriority AS value FROM (SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderpriority < '3') UNION ALL SELECT 'DE_priority', o_orderpriority FROM (SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderpriority < '3')")
def overlay(spark, d):
    pack = _pack(spark, d)
    return catalog.overlaid(catalog.rules_of(pack), catalog.codelists_of(pack), True, ("priority",))[1]


@query("s09_resolved_codelist", f"SELECT 'seg_' || lower(s) AS rule_id, p AS value FROM {_SEGMENTS} q, (SELECT DISTINCT o_orderpriority AS p FROM orders) o WHERE s < 'C' OR s = 'MACHINERY'")
def resolved_codelist(spark, d):
    pack = _pack(spark, d)
    return catalog.resolved_codelist(catalog.rules_of(pack), catalog.codelists_of(pack), catalog.field_lists_of(pack))


@query("s10_row_numbers", "SELECT o_orderkey AS id, CAST(row_number() OVER (ORDER BY o_orderkey) + 1 AS BIGINT) AS row FROM orders")
def row_numbers(spark, d):
    path = scratch_path(spark, "rows")
    table(spark, d, "orders").select(F.col("o_orderkey").alias("id")).orderBy("id").write.parquet(path)
    return tables.with_row_numbers(spark.read.parquet(path)).select("id", "row")


@query("s11_reference_date", f"SELECT substr(day, 1, 10) AS reference, (SELECT count(*) FROM {ORDERS_SQL} u WHERE u.day < t.day) AS before FROM {ORDERS_SQL} t ORDER BY id LIMIT 1")
def reference(spark, d):
    rows = dirty_orders(spark, d).select(F.col("id").alias("row"), F.col("day").alias("c0070"))
    found = tables.reference_date({"B99.00": rows})
    return rows.agg(F.any_value(found).alias("reference"), F.count_if(F.col("c0070") < found).alias("before"))


@query("k01_issue_sink", f"SELECT rule_level, rule_id, count(*) AS n, CAST(sum(row) AS BIGINT) AS row_sum FROM {RUN} r GROUP BY ALL")
def issue_sink(spark, d):
    path = scratch_path(spark, "issues")
    sinks.write_issues(run_findings(spark, d), path)
    return spark.read.parquet(path).groupBy("rule_level", "rule_id").agg(F.count("*").alias("n"), F.sum("row").alias("row_sum"))


@query(
    "k02_manifest_sink",
    f"""SELECT '{{"catalog":{{"de_annex":false,"rule_count":3,"version":"1.0"}},"finished_at":"","input":{{"hash":"","path":"in","source_type":"csv_dir"}},"issues":{{"by_severity":{{"ERROR":' || e || ',"WARNING":' || w || '}},"count":' || (e + w) || '}},"run_id":"{RUN_ID}","started_at":"2024-01-31T08:00:00Z","templates_loaded":["B01.00","B02.00"]}}' AS value
    FROM (SELECT count(*) FILTER (severity = 'ERROR') AS e, count(*) FILTER (severity = 'WARNING') AS w FROM {RUN} r)""",
)
def manifest_sink(spark, d):
    path = scratch_path(spark, "manifest")
    sinks.write_manifest(R.manifest(run_findings(spark, d), ["B02.00", "B01.00"], "1.0", 3, "in", "csv_dir", started_at="2024-01-31T08:00:00Z"), path)
    return spark.read.text(path)


_DIMS = "SELECT 'template' AS dimension, template AS value, count(*) AS n FROM {0} r GROUP BY ALL UNION ALL SELECT 'rule_type', rule_type, count(*) FROM {0} r GROUP BY ALL UNION ALL SELECT 'rule_level', rule_level, count(*) FROM {0} r GROUP BY ALL UNION ALL SELECT 'severity', severity, count(*) FROM {0} r GROUP BY ALL UNION ALL SELECT 'total', '', count(*) FROM {0} r UNION ALL SELECT 'written', '', count(*) FROM {0} r"


@query("k01_observed_run", _DIMS.format(RUN))
def observed_run(spark, d):
    """Counts that were taken while the findings were written, beside the number that were written."""
    path = scratch_path(spark, "observed")
    counts = sinks.write_observed(run_findings(spark, d), path).counts
    named = lambda df, name: df.select(F.lit(name).alias("dimension"), F.lit("").alias("value"), F.col("n"))
    written = spark.read.parquet(path).agg(F.count("*").alias("n"))
    return R.counts_by(counts, ("template", "rule_type", "rule_level", "severity"), n="n").unionByName(named(R.totals(counts, n="n").select(F.col("total").alias("n")), "total")).unionByName(named(written, "written"))


@query("k02_committed_runs", f"SELECT 'one' AS run_id, rule_id, count(*) AS n, CAST(sum(row) AS BIGINT) AS row_sum, true AS told FROM {RUN} r GROUP BY ALL UNION ALL SELECT 'two', rule_id, count(*), CAST(sum(row) AS BIGINT), true FROM {LATER} r GROUP BY ALL")
def committed_runs(spark, d):
    """Two runs; the first was committed before with other findings, and a third failed before it was."""
    base = scratch_path(spark, "runs")
    about = {"tables": ["B01.00", "B02.00"], "catalog_version": "1.0", "rule_count": 3}
    other = run_findings(spark, d, PRIORITIES[:2], 50)
    for run, found in (("one", other), ("two", other), ("one", run_findings(spark, d))):
        sinks.commit_run(found, base, run, **about)
    sinks.write_issues(other, f"{base}/staged/three/left-behind")
    found = sinks.committed(spark, base).groupBy("run_id", "rule_id").agg(F.count("*").alias("n"), F.sum("row").alias("row_sum"))
    sizes = found.groupBy("run_id").agg(F.sum("n").alias("size"))
    told = sinks.manifests(spark, base).select("run_id", F.get_json_object("manifest", "$.issues.count").cast("long").alias("count")).join(sizes, "run_id")
    return found.join(told, "run_id").select("run_id", "rule_id", "n", "row_sum", (F.col("count") == F.col("size")).alias("told"))


_FILES = "SELECT c_mktsegment AS s, string_agg(c_name, chr(10) ORDER BY c_custkey) || chr(10) AS content FROM customer GROUP BY 1"
_FILE = "length('segment=' || s) || ':segment=' || s || sha256(content)"


@query("a11_file_fingerprint", f"SELECT count(*) AS files, {digest_sql(_FILE)} AS digest FROM ({_FILES}) q")
def file_fingerprint(spark, d):
    """A file for each market segment, known by its folder."""
    path = scratch_path(spark, "segments")
    rows = table(spark, d, "customer").select(F.col("c_mktsegment").alias("segment"), "c_custkey", "c_name")
    rows.repartition("segment").sortWithinPartitions("segment", "c_custkey").select("segment", "c_name").write.partitionBy("segment").text(path)
    return R.file_fingerprint(spark, path, F.element_at(F.split("path", "/"), -2))


@query("a11_changed_ranges", "SELECT c_mktsegment AS file, CAST(floor((r - 1) / 50) AS BIGINT) AS range, 'changed' AS change FROM (SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS r FROM customer) WHERE c_custkey % 101 = 0 GROUP BY ALL")
def changed_ranges(spark, d):
    """Two deliveries of a file for each market segment: ranges of 50 lines in which a line was changed."""
    rows = table(spark, d, "customer").select(F.col("c_mktsegment").alias("segment"), "c_custkey", "c_name")
    told = []
    for name, text in (("before", F.col("c_name")), ("after", F.when(F.col("c_custkey") % 101 == 0, F.concat("c_name", F.lit("!"))).otherwise(F.col("c_name")))):
        path = scratch_path(spark, name)
        rows.withColumn("c_name", text).repartition("segment").sortWithinPartitions("segment", "c_custkey").select("segment", "c_name").write.partitionBy("segment").text(path)
        told.append(R.range_fingerprints(spark, path, F.split_part(F.element_at(F.split("path", "/"), -2), F.lit("="), F.lit(2)), lines=50))
    return R.changed_ranges(*told)


@query("t01_empty_delivery", f"SELECT 'empty' AS delivery, 'SYS_001' AS rule_id, '' AS template, 1 AS n UNION ALL SELECT 'full', 'm1', 'B02.00', count(*) FROM {ORDERS_SQL} t WHERE {miss('amount')}")
def empty_delivery(spark, d):
    """Nothing else is said of a delivery without tables, whatever is required or checked."""
    checks = {"B02.00": [C.mandatory("m1", "amount")]}
    given = {"empty": {}, "full": {"B02.00": dirty_orders(spark, d), "B99.00": table(spark, d, "customer")}}
    found = [validate(spark, t, checks, required=["B99.00"]).select(F.lit(k).alias("delivery"), "rule_id", "template") for k, t in given.items()]
    return found[0].unionByName(found[1]).groupBy("delivery", "rule_id", "template").agg(F.count("*").alias("n"))


@query(
    "t02_contract_run",
    "SELECT * FROM (VALUES ('SYS_002', 'B99.00', '', 'ERROR', 1), ('STRUCT_001', 'B77.99', '', 'WARNING', 1), ('STRUCT_002', 'B02.00_TypeA', 'cust', 'WARNING', 1), ('STRUCT_003', 'B02.00_TypeA', 'c0030', 'ERROR', 1), ('gone', 'B02.00_TypeA', 'nowhere', 'ERROR', 1)) v(rule_id, template, field_code, severity, n)"
    f" UNION ALL SELECT 'm1', 'B02.00_TypeA', 'amount', 'ERROR', count(*) FROM {ORDERS_SQL} t WHERE {miss('amount')}",
)
def contract_run(spark, d):
    given = {"B02.00_TypeA": dirty_orders(spark, d).select("id", "amount", "cust"), "B77.99": table(spark, d, "customer").select("c_custkey").toDF("id")}
    wanted = spark.createDataFrame([("B02.00", "amount", True), ("B02.00", "c0030", True), ("B99.00", "c0010", True)], "table string, field_code string, mandatory boolean")
    checks = {"B02.00": [C.mandatory("m1", "amount"), C.mandatory("gone", "nowhere"), C.greater_zero("silent", "nothing")]}
    found = validate(spark, given, checks, required=["B99.00"], expected=wanted)
    return found.groupBy("rule_id", "template", "field_code", "severity").agg(F.count("*").alias("n"))
