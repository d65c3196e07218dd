"""Runs that a rule pack drives: rows of rules become checks and joins over the tables delivered.

A rule's family is told by its level and type, what it does within the family
by ``operator``, ``business_rule`` or ``format_type``; rules of no known kind
give nothing.  All row checks of a table are one scan, all its code lists one
join, all its keys and dependencies one aggregate.  The pack itself is read to
the driver: it is the plan, some hundreds of rows; its lists and the tables are
not.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tabguard.functions import expressions as E
from tabguard.functions import predicates as P
from tabguard.issues import ERROR, ISSUE_COLUMNS, WARNING, issue_struct
from tabguard.operators import business as B
from tabguard.operators import checks as C
from tabguard.operators import cross as X
from tabguard.operators.contract import structure_issues, system_issues
from tabguard.plans.validation import table_findings
from tabguard.sources.catalog import resolved_codelist
from tabguard.sources.tables import family, first_of_family, reference_date, resolve_column

#: levels whose rules warn unless they say otherwise
WARNING_LEVELS = ("CROSS", "DQ")


@dataclass
class TablePlan:
    """What the rules ask of one table."""

    checks: list[C.Check] = field(default_factory=list)
    lists: list[tuple[str, str]] = field(default_factory=list)
    unique: dict[str, list[str]] = field(default_factory=dict)
    dependent: dict[str, tuple[str, str]] = field(default_factory=dict)
    #: columns of other tables' rows that conditions look at: (name, table, column)
    beside: list[tuple[str, str, str]] = field(default_factory=list)
    #: (rule, findings with ``value`` and perhaps the row column)
    joins: list[tuple[Row, DataFrame]] = field(default_factory=list)


class Compiler:
    """Rules against the tables of one delivery."""

    def __init__(self, tables: Mapping[str, DataFrame], day: Column | None, row: str):
        self.tables, self.day, self.row = tables, day, row

    def table(self, rules: Sequence[Row], key: str) -> TablePlan:
        plan, df = TablePlan(), self.tables[key]
        for rule in rules:
            make = KINDS.get((rule["rule_level"] if rule["rule_level"] in ("CROSS", "DQ", "DPM") else "", rule["rule_type"])) or KINDS.get((rule["rule_level"], ""))
            if make is None:
                continue
            made = make(self, rule, df, plan)
            for check in made if isinstance(made, list) else [made] if made is not None else []:
                plan.checks.append(self.gated(rule, check, df, plan))
        return plan

    def column(self, df: DataFrame, code: str | None) -> str:
        """The table's column of this code, or the code itself, which it then lacks."""
        return (resolve_column(df, code) or code) if code else ""

    def how(self, rule: Row, code: str | None = None) -> dict:
        """What every finding of a rule says."""
        severity = rule["severity"] if rule["severity_given"] else WARNING if rule["rule_level"] in WARNING_LEVELS else ERROR
        return {
            "rule_level": rule["rule_level"], "rule_type": rule["rule_type"], "severity": severity, "label": rule["field_label"],
            "message": rule["message"], "reference": rule["dpm_reference"], "code": code or rule["field_code"],
        } | ({"explanation": rule["explanation"]} if rule["explanation"] else {})

    def gated(self, rule: Row, check: C.Check, df: DataFrame, plan: TablePlan) -> C.Check:
        """The check where all conditions of the rule hold; ``B01.00.c0050`` is a column of another table's row."""
        terms = [self.condition(g, df, plan) for g in rule["condition"] or []]
        return C.gated(check, reduce(E.and_, terms)) if terms else check

    def condition(self, g: Row, df: DataFrame, plan: TablePlan) -> E.Val:
        name = g["field"]
        if name.count(".") == 2:
            other, column = name.rsplit(".", 1)
            there = first_of_family(self.tables, other)
            found = resolve_column(there, column) if there is not None else None
            if found and self.row in there.columns and self.row in df.columns and (name, other, found) not in plan.beside:
                plan.beside.append((name, other, found))
        else:
            name = self.column(df, name)
        said = lambda t: E.text(F.lit(t))
        v, op = E.field(name), g["operator"] or "eq"
        if op in ("in", "not_in"):
            return (E.is_in if op == "in" else E.not_in)(v, [said(t) for t in g["values"] or []])
        if op in ("is_null", "is_not_null", "is_reported"):
            return getattr(E, op)(v)
        return {"eq": E.eq, "ne": E.ne, "neq": E.ne, "lt": E.lt, "le": E.le, "gt": E.gt, "ge": E.ge}[op](v, said(g["value"]))

    # ---- one method a family -----------------------------------------------------

    def mandatory(self, rule: Row, df: DataFrame, plan: TablePlan) -> C.Check:
        return C.mandatory(rule["rule_id"], self.column(df, rule["field_code"]), **self.how(rule))

    def codelist(self, rule: Row, df: DataFrame, plan: TablePlan) -> None:
        found = resolve_column(df, rule["field_code"])
        if found:
            plan.lists.append((rule["rule_id"], found))

    def consistency(self, rule: Row, df: DataFrame, plan: TablePlan) -> C.Check | None:
        f, op, how = self.column(df, rule["field_code"]), rule["operator"], self.how(rule)
        if op == "dropdown":
            return self.codelist(rule, df, plan)
        if op in ("sum_formula", "floor_formula"):
            terms = [(t["sign"], self.column(df, t["field"])) for t in rule["terms"] or []]
            formula = {**how, "severity": rule["severity"] if rule["severity_given"] else WARNING}
            return C.sum_formula(rule["rule_id"], f, terms, 1.0 if rule["tolerance"] is None else rule["tolerance"], op == "floor_formula", **formula) if terms else None
        if op == "isin":
            kind = resolve_column(df, rule["type_field"] or "c0040")
            return C.isin_if_typed(rule["rule_id"], f, kind, **how)
        plain = {"greater_zero": C.greater_zero, "not_negative": C.not_negative, "whole_from_one": C.whole_from_one, "not_reported": C.not_reported, "equal_zero": C.equal_zero, "integer": C.integer_text}
        return plain[op](rule["rule_id"], f, **how) if op in plain else self.datatype(rule, df, plan)

    def datatype(self, rule: Row, df: DataFrame, plan: TablePlan) -> C.Check | None:
        f = self.column(df, rule["field_code"])
        c = F.col(f"`{f}`")
        good = {"lei": P.is_lei, "country": P.is_country, "currency": P.is_currency, "numeric": P.is_numeric, "date": P.is_iso_date_text, "boolean": P.is_bool_text}.get(rule["operator"])
        shown = F.upper(c) if rule["operator"] == "currency" and rule["rule_level"] == "L2" else None
        return C.format_check(rule["rule_id"], f, good(c), value=shown, **self.how(rule)) if good and f else None

    def conditional_mandatory(self, rule: Row, df: DataFrame, plan: TablePlan) -> C.Check:
        target = rule["target_field"]
        return C.conditional_mandatory(rule["rule_id"], self.column(df, target), self.column(df, rule["condition_field"]), rule["operator"] or "eq", rule["condition_value"], **self.how(rule, target))

    def plausibility(self, rule: Row, df: DataFrame, plan: TablePlan) -> C.Check:
        fields = [self.column(df, rule[k]) or None for k in ("field", "field2", "field3")]
        low, high = rule["range_min"], rule["range_max"]
        return C.plausibility(rule["rule_id"], rule["operator"], *fields, low=0.0 if low is None else low, high=high, **self.how(rule, rule["field"]))

    def date(self, rule: Row, df: DataFrame, plan: TablePlan) -> C.Check | None:
        op, _, against = (rule["operator"] or "").partition("_")
        other = self.day if against == "refdate" else self.column(df, rule["field2"])
        if other is None or isinstance(other, str) and not other:
            return None
        return C.date_order(rule["rule_id"], self.column(df, rule["field"]), op, other, **self.how(rule, rule["field"]))

    def identifier(self, rule: Row, df: DataFrame, plan: TablePlan) -> C.Check:
        return C.identifier_format(rule["rule_id"], self.column(df, rule["field"]), rule["format_type"], **self.how(rule, rule["field"]))

    def uniqueness(self, rule: Row, df: DataFrame, plan: TablePlan) -> None:
        plan.unique[rule["rule_id"]] = [c for c in (resolve_column(df, f) for f in rule["key_fields"] or []) if c]

    def business(self, rule: Row, df: DataFrame, plan: TablePlan) -> list[C.Check]:
        name = rule["business_rule"]
        if name == "lei_name_consistency":
            key, value = (resolve_column(df, rule[k]) for k in ("key_field", "value_field"))
            if key and value:
                plan.dependent[rule["rule_id"]] = (key, value)
            return []
        if name == "non_structured_fields_empty":
            made = B.non_structured_fields_empty(self.column(df, rule["field"] or "c0360"), [self.column(df, f) for f in rule["structured_fields"] or []])
        else:
            make = BUSINESS.get(name)
            given = [self.column(df, rule[k] or default) for k, default in zip(("field", "field2"), make[1], strict=False)] if make else []
            made = [make[0](*given)] if make else []
        return [C.Check(**{**c.__dict__, **self.how(rule, c.field), "rule_id": rule["rule_id"]}) for c in made]

    def reference(self, rule: Row, df: DataFrame, plan: TablePlan, skip: Sequence[str] = ()) -> None:
        parent = first_of_family(self.tables, rule["ref_template"] or "?")
        there = resolve_column(parent, rule["ref_field"]) if parent is not None else None
        own = resolve_column(df, rule["field"] or rule["field_code"])
        if there and own:
            plan.joins.append((rule, X.unmatched(df, own, parent, there, [self.row] if self.row in df.columns else [], skip)))

    def cross(self, rule: Row, df: DataFrame, plan: TablePlan) -> C.Check | None:
        op, f = rule["operator"], rule["field"] or rule["field_code"]
        own, how = resolve_column(df, f), self.how(rule, f)
        rows = [self.row] if self.row in df.columns else []
        if op == "reference":
            return self.reference(rule, df, plan, X.SKIPPED_REFERENCES)
        if own is None:
            return None
        if op in ("totals", "conditional_totals"):
            other = first_of_family(self.tables, rule["ref_template"] or "?")
            there = resolve_column(other, rule["ref_field"]) if other is not None else None
            if there:
                if op == "totals":
                    found = X.totals_differ(df, own, other, there, 1.0 if rule["tolerance"] is None else rule["tolerance"])
                else:
                    found = X.conditional_totals_differ(df, own, other, there, self.column(other, rule["category_field"]), rule["categories"] or [], 0.05 if rule["tolerance"] is None else rule["tolerance"])
                plan.joins.append((rule, found.select(F.concat_ws(" / ", F.format_number("total_a", 2), F.format_number("total_b", 2)).alias("value"))))
        elif op == "counted_twice":
            other = first_of_family(self.tables, rule["ref_template"] or "?")
            there = resolve_column(other, f) if other is not None else None
            if there:
                plan.joins.append((rule, X.overlapping(other.select(F.col(f"`{there}`").alias(own)), df, own, rows)))
        elif op == "needs_table":
            plan.joins.append((rule, X.needs_table(self.tables, df, own, rule["contains"], rule["tables"] or [], rows)))
        elif op == "rank":
            return X.rank_check(rule["rule_id"], own, **how)
        elif op == "derived_amount":
            kind = resolve_column(df, rule["type_field"] or "c0250")
            return X.derived_amount(rule["rule_id"], own, self.column(df, rule["target_field"]), self.column(df, rule["field2"]), kind, 1.0 if rule["tolerance"] is None else rule["tolerance"], **how)
        elif op == "category_needs_field":
            return X.category_needs_field(rule["rule_id"], own, rule["contains"], self.column(df, rule["field2"]), df.columns, **how)
        return None


#: by (level where it decides, type); a level with no type takes all of its rules
KINDS: dict[tuple[str, str], Callable] = {
    ("", "MANDATORY_FIELD"): Compiler.mandatory,
    ("", "CODELIST_CHECK"): Compiler.codelist,
    ("", "CONSISTENCY_CHECK"): Compiler.consistency,
    ("DPM", "DATATYPE_CHECK"): Compiler.datatype,
    ("DPM", "FORMAT_CHECK"): Compiler.datatype,
    ("DQ", "CONDITIONAL_MANDATORY"): Compiler.conditional_mandatory,
    ("DQ", "VALUE_PLAUSIBILITY"): Compiler.plausibility,
    ("DQ", "DATE_CONSISTENCY"): Compiler.date,
    ("DQ", "CROSS_TEMPLATE_CONSISTENCY"): Compiler.reference,
    ("DQ", "UNIQUENESS_CHECK"): Compiler.uniqueness,
    ("DQ", "BUSINESS_LOGIC"): Compiler.business,
    ("DQ", "FORMAT_CHECK"): Compiler.identifier,
    ("CROSS", ""): Compiler.cross,
}
#: by name, with the columns it looks at where the rule names none
BUSINESS: dict[str, tuple[Callable, tuple[str, ...]]] = {
    "structural_subordination_rank": (B.structural_subordination_rank, ("c0160", "c0170")),
    "own_funds_rank_check": (B.own_funds_rank_check, ("c0060", "c0170")),
    "zero_coupon_accruals": (B.zero_coupon_accruals, ("c0110", "c0220")),
    "unsecured_no_collateral": (B.unsecured_no_collateral, ("c0300", "c0310")),
    "securities_count_consistency": (B.securities_count_consistency, ("c0410", "c0420")),
    "ccp_cleared_stay_na": (B.ccp_cleared_stay_na, ("c0380", "c0390")),
    "carrying_amount_plausibility": (B.carrying_amount_plausibility, ("c0070", "c0080")),
    "eur_exchange_rate_positive": (B.eur_exchange_rate_positive, ("c0060",)),
    "eur_currency_rate_one": (B.eur_currency_rate_one, ("c0020", "c0060")),
}


def _told(rule: Row, how: dict, key: str, found: DataFrame, row: str) -> DataFrame:
    """Findings of a join with what the rule says of them."""
    named = {k: how[k] for k in ("rule_level", "rule_type", "severity", "message")} | {"explanation": rule["explanation"]}
    return found.select(issue_struct(row=F.col(row) if row in found.columns else None, value=F.col("value"), rule_id=rule["rule_id"], template=key, field_code=how["code"], field_label=how["label"], dpm_reference=how["reference"], **named).alias("i")).select("i.*")


def _by_rule(rules: Sequence[Row], compiler: Compiler, key: str, found: DataFrame, row: str) -> DataFrame:
    """Findings of several rules, (rule_id, value) and perhaps row and explanation, with what each rule says."""
    spark = found.sparkSession
    meta = [{"rule_id": r["rule_id"], "field": ",".join(r["key_fields"]) if r["key_fields"] else r["value_field"] or r["field_code"], "own": r["explanation"]} | {k: v for k, v in compiler.how(r).items() if k not in ("code", "explanation")} for r in rules]
    names = ("rule_id", "rule_level", "rule_type", "severity", "label", "message", "reference", "field", "own")
    told = F.broadcast(spark.createDataFrame([[m[n] for n in names] for m in meta], ", ".join(f"{n} string" for n in names)))  # a row a rule
    more = F.when(F.col("own") == "", F.col("explanation")).otherwise(F.col("own")) if "explanation" in found.columns else F.col("own")
    fixed = {n: F.col(n) for n in ("rule_id", "rule_level", "rule_type", "severity", "message")}
    return found.join(told, "rule_id").select(issue_struct(row=F.col(row) if row in found.columns else None, value=F.col("value"), template=key, field_code=F.col("field"), field_label=F.col("label"), dpm_reference=F.col("reference"), explanation=more, **fixed).alias("i")).select("i.*")


def run_pack(
    spark: SparkSession, tables: Mapping[str, DataFrame], rules: DataFrame, codelists: DataFrame, field_lists: DataFrame,
    required: Sequence[str] = (), expected: DataFrame | None = None, given_date: str | None = None, row: str = "row",
) -> DataFrame:
    """Findings of a delivery under a rule pack, as ``catalog`` reads and overlays it.

    ``row`` names the column with a row's number; keys and dependencies take
    the first row by it, and are passed over in tables that lack it.  Rules apply
    to every variant of their table.  A delivery without tables gives SYS_001
    and nothing else.  Rules that are not enabled, of unknown kind, or whose
    columns, list or other table are absent give nothing, but a mandatory column
    that is absent is a finding.
    """
    out = system_issues(spark, tables, required)
    if not tables:
        return out
    parts = [out]
    if expected is not None:
        parts.append(structure_issues(spark, {k: df.drop(row) for k, df in tables.items()}, expected))
    day = reference_date(tables, given_date, row=row)
    compiler = Compiler(tables, None if day is None else P.parse_date(day), row)
    allowed = resolved_codelist(rules, codelists, field_lists)
    by_template: dict[str, list[Row]] = {}
    for rule in rules.where("enabled").orderBy("rule_id").collect():
        if rule["template"]:
            by_template.setdefault(rule["template"], []).append(rule)
    for key in sorted(tables):
        own = [r for base, rs in sorted(by_template.items()) if key in family(tables, base) for r in rs]
        by_id = {r["rule_id"]: r for r in own}
        plan = compiler.table(own, key)
        df = tables[key]
        for name, other, column in plan.beside:
            df = X.aligned(df, first_of_family(tables, other), column, row, name)
        if plan.checks:
            parts.append(table_findings(spark, key, df, plan.checks, row))
        kept = [row] if row in df.columns else []
        if plan.lists:
            parts.append(_by_rule([by_id[r] for r, _ in plan.lists], compiler, key, C.codelist_joins(tables[key], plan.lists, allowed, kept), row))
        if kept and (plan.unique or plan.dependent):
            found = X.first_seen(tables[key], plan.unique, plan.dependent, kept, kept)
            value = F.coalesce(F.col("value"), F.array_join(F.from_json("key", "array<string>"), ", "))
            parts.append(_by_rule([by_id[r] for r in (*plan.unique, *plan.dependent)], compiler, key, found.select(*kept, "rule_id", value.alias("value")), row))
        parts += [_told(rule, compiler.how(rule, rule["field"] or None), key, found, row) for rule, found in plan.joins]
    return reduce(DataFrame.unionByName, [p.select(*ISSUE_COLUMNS) for p in parts])
