"""A validation run: system, structure and rule findings of a delivery in one table."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from tabguard.functions.expressions import Val, violated
from tabguard.issues import ISSUE_COLUMNS, no_issues, table_issue
from tabguard.operators.checks import Check, columns_missing, fuse, needs
from tabguard.operators.contract import structure_issues, system_issues
from tabguard.sources.tables import family

TableChecks = Mapping[str, Sequence[Check]]
Extra = Callable[[Mapping[str, DataFrame]], DataFrame]


def assertion(rule_id: str, field: str, condition: Val | None, claim: Val | None, **how) -> Check:
    """A condition/assertion rule as a check of single rows.

    Values made with ``expressions.field`` may name columns that a table lacks:
    rows whose evaluation needs one are passed over.
    """
    named = tuple(n for v in (condition, claim) if v is not None for n in v.needs)
    return Check(rule_id, field, violated(condition, claim), **{"rule_type": "ASSERTION", "needs": (*named, *needs(missing=field))} | how)


def first_row_only(df: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """What a table-scope assertion looks at."""
    return df.orderBy(*order_by).limit(1)


def table_findings(spark: SparkSession, key: str, df: DataFrame, checks: Sequence[Check], row: str | None = None) -> DataFrame:
    """Checks of one table: its row checks fused, a finding for each mandatory column it lacks.

    Other checks of a field that the table lacks are left out, but assertions
    are kept, since they need not look at the field they report.  Second and
    third fields that it lacks are null in every row.
    """
    absent = columns_missing(df, checks)
    usable = [c for c in checks if c.field in df.columns or c.rule_type == "ASSERTION"]
    parts = [fuse(df, [Check(**{**c.__dict__, "template": key}) for c in usable], row=row if row in df.columns else None)] if usable else []
    parts += [table_issue(spark, rule_id=c.rule_id, rule_level=c.rule_level, rule_type=c.rule_type, template=key, severity=c.severity, field_code=c.field, message="column is missing") for c in absent]
    return reduce(DataFrame.unionByName, parts) if parts else no_issues(spark)


def validate(spark: SparkSession, tables: Mapping[str, DataFrame], checks: TableChecks, required: Sequence[str] = (), expected: DataFrame | None = None, extra: Sequence[Extra] = (), row: str | None = "row") -> DataFrame:
    """Findings of the whole delivery; an empty one gives SYS_001 and nothing else.

    ``checks`` are row checks by base table id, applied to all its variants, one
    scan each.  ``extra`` are functions of the tables, for checks with joins.
    """
    out = system_issues(spark, tables, required)
    if not tables:
        return out
    parts = [out]
    if expected is not None:
        parts.append(structure_issues(spark, tables, expected))
    for base, own in checks.items():
        parts += [table_findings(spark, key, tables[key], own, row) for key in family(tables, base)]
    parts += [f(tables).select(*ISSUE_COLUMNS) for f in extra]
    return reduce(DataFrame.unionByName, parts)
