"""Checks of what was delivered: which tables, which columns.  Plans, not data, are looked at."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabguard.issues import ERROR, WARNING, issue_struct, no_issues, table_issue


def base_id(key: str) -> str:
    return key.split("_", 1)[0]


def system_issues(spark: SparkSession, tables: Mapping[str, DataFrame], required: Sequence[str] = ()) -> DataFrame:
    """SYS_001 for an empty delivery, else SYS_002 for each required table without that exact key."""
    if not tables:
        return table_issue(spark, rule_id="SYS_001", rule_level="SYSTEM", rule_type="SYSTEM", severity=ERROR, message="no table was delivered")
    missing = [t for t in required if t not in tables]
    if not missing:
        return no_issues(spark)
    names = spark.createDataFrame([(t,) for t in missing], "t string")
    return names.select(issue_struct(rule_id="SYS_002", rule_level="SYSTEM", rule_type="SYSTEM", severity=ERROR, template=F.col("t"), message="required table is missing").alias("i")).select("i.*")


def delivered_columns(spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table_key, base, column) of the delivery."""
    rows = [(k, base_id(k), c) for k, df in sorted(tables.items()) for c in df.columns]
    return spark.createDataFrame(rows, "table_key string, base string, column string")


def structure_issues(spark: SparkSession, tables: Mapping[str, DataFrame], expected: DataFrame) -> DataFrame:
    """STRUCT_001 unknown tables, STRUCT_002 unknown c-columns, STRUCT_003 absent mandatory columns.

    ``expected`` has (table, field_code, mandatory); a variant is held against
    its base id.
    """
    got = delivered_columns(spark, tables)
    known = expected.select(F.col("table").alias("base")).distinct()
    keys = got.select("table_key", "base").distinct()
    fields = expected.select(F.col("table").alias("base"), F.col("field_code").alias("column"))
    wanted = keys.join(expected.where("mandatory").select(F.col("table").alias("base"), F.col("field_code").alias("column")), "base")
    parts = [
        ("STRUCT_001", WARNING, "unknown table", keys.join(known, "base", "left_anti").select("table_key", F.lit("").alias("column"))),
        ("STRUCT_002", WARNING, "unknown column", got.where(F.col("column").startswith("c")).join(known, "base", "left_semi").join(fields, ["base", "column"], "left_anti").select("table_key", "column")),
        ("STRUCT_003", ERROR, "mandatory column is missing", wanted.join(got.select("table_key", "column"), ["table_key", "column"], "left_anti").select("table_key", "column")),
    ]
    out = no_issues(spark)
    for rule, severity, message, rows in parts:
        out = out.unionByName(rows.select(issue_struct(rule_id=rule, rule_level="STRUCTURE", rule_type="STRUCTURE", severity=severity, template=F.col("table_key"), field_code=F.col("column"), message=message).alias("i")).select("i.*"))
    return out
