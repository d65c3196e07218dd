"""The findings table: one schema for every check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabguard.functions.predicates import issue_value

ISSUE_COLUMNS = ("rule_id", "rule_level", "rule_type", "template", "severity", "row", "field_code", "field_label", "value", "message", "explanation", "dpm_reference")
ISSUE_TYPES = {c: "string" for c in ISSUE_COLUMNS} | {"row": "bigint"}
ISSUE_DDL = ", ".join(f"{c} {ISSUE_TYPES[c]}" for c in ISSUE_COLUMNS)
ERROR, WARNING = "ERROR", "WARNING"


def issue_struct(row: Column | None = None, value: Column | None = None, **fixed: str | Column) -> Column:
    """One finding; what is not given is an empty text, a missing ``row`` is null."""
    cells = []
    for name in ISSUE_COLUMNS:
        if name == "row":
            cell = (row if row is not None else F.lit(None)).cast("bigint")
        elif name == "value":
            cell = issue_value(value if value is not None else F.lit(""))
        else:
            given = fixed.get(name, "")
            cell = given if isinstance(given, Column) else F.lit(given)
        cells.append(cell.alias(name))
    return F.struct(*cells)


def table_issue(spark, **fixed) -> DataFrame:
    """A one-row findings table about a whole table."""
    return spark.range(1).select(issue_struct(**fixed).alias("i")).select("i.*")


def no_issues(spark) -> DataFrame:
    return spark.createDataFrame([], ISSUE_DDL)
