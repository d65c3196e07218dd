"""Row checks, compiled to Columns and fused: one scan of a table runs all of them.

Checks refer to what they need of a field (is it missing, its number, its date,
does the table lack it) by name; ``fuse`` computes each of these once per row,
however many checks use it.  A field that a table lacks is null in every row.

A check is a Boolean Column with what it reports.  ``fuse`` packs the checks of
a table into words of flags, lets go of the rows that have none, and only then
writes findings: clean rows cost the Booleans alone, N checks read the table
once, and nothing is shuffled.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabguard.functions import predicates as P
from tabguard.functions.expressions import Val, holds
from tabguard.issues import ERROR, ISSUE_COLUMNS, WARNING, issue_struct, no_issues

#: flags in a word, and how many kinds of shown values one method takes
BITS, FEW = 63, 12
ALWAYS_ALLOWED = ("Not available", "Not applicable", "N/A", "NA", "")


#: what checks share of a field; ``absent`` is known without looking at rows
DERIVED = {"missing": P.is_missing, "decimal": P.decimal_comma_double, "grouped": P.grouped_double, "day": P.parse_date}


def derived(kind: str, field: str) -> Column:
    """A shared value of a field; the check has to name it in ``needs``."""
    return F.col(f"`{kind} of {field}`")


def missing(field: str) -> Column:
    return derived("missing", field)


def needs(**kinds: str | Sequence[str | None] | None) -> tuple[tuple[str, str], ...]:
    """(kind, field) of the shared values a check uses; fields that are None are left out."""
    return tuple((k, f) for k, fs in kinds.items() for f in ([fs] if isinstance(fs, str) else fs or []) if f is not None)


@dataclass(frozen=True)
class Check:
    rule_id: str
    field: str
    failed: Column
    value: Column | None = None
    severity: str = ERROR
    rule_level: str = ""
    rule_type: str = ""
    template: str = ""
    message: str = ""
    explanation: str = ""
    needs: tuple[tuple[str, str], ...] = ()
    label: str = ""
    reference: str = ""
    code: str = ""  # what the field is called in findings, where that is not its column's name

    @property
    def shown(self) -> Column:
        return self.value if self.value is not None else F.col(self.field)


def absent(field: str) -> Column:
    """Whether the table lacks the field; shared too."""
    return derived("absent", field)


def prepared(df: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """The table with what its checks share; columns that they name and it lacks are null texts."""
    wanted = sorted({n for c in checks for n in c.needs})
    have = {c.lower() for c in df.columns}
    lacking = {f for _, f in wanted if f.lower() not in have}
    df = df.withColumns({f: F.lit(None).cast("string") for f in sorted(lacking)})
    return df.withColumns({f"{kind} of {field}": F.lit(field in lacking) if kind == "absent" else DERIVED[kind](F.col(f"`{field}`")) for kind, field in wanted})


def _words(n: int) -> str:
    """Flags 0 to n as an array of 64-bit words: check i is bit i % BITS of word i // BITS."""
    words = []
    for lo in range(0, n, BITS):
        bits = [f"if(`failed {i}`, {1 << (i - lo)}L, 0L)" for i in range(lo, min(lo + BITS, n))]
        while len(bits) > 1:  # a flat tree, not a chain
            bits = [f"({' | '.join(bits[i : i + 2])})" for i in range(0, len(bits), 2)]
        words += bits
    return f"array({', '.join(words)})"


def _apart(c: Column) -> Column:
    """True in every row.  A projection that holds a lambda is generated in many small methods instead of one that grows with the checks."""
    return F.exists(F.array(c.isNull()), lambda x: x | ~x)


def fuse(df: DataFrame, checks: Sequence[Check], keys: Sequence[str] = (), row: str | None = None) -> DataFrame:
    """``keys`` and the findings of all checks; ``row`` names the column that holds the row number.

    Any number of checks is one scan.  A row's flags are packed into words; words
    that are not zero are taken apart into the numbers of failed checks, and only
    these get texts and values.  Shared values, flags and findings are each
    computed in small methods (``_apart``), which the JVM compiles at any number
    of checks.
    """
    if not checks:
        return df.limit(0).select(*keys).join(no_issues(df.sparkSession)) if keys else no_issues(df.sparkSession)
    some = F.col(f"`{checks[0].field if checks[0].field in df.columns else df.columns[0]}`")
    flagged = prepared(df, checks).withColumn("shared of row", _apart(some))
    flagged = flagged.select("*", _apart(some).alias("flags of row"), *[c.failed.alias(f"failed {i}") for i, c in enumerate(checks)])
    flagged = flagged.withColumns({"words of row": F.expr(_words(len(checks))), "open of row": F.col("shared of row") & F.col("flags of row")})
    bits = lambda word, n: f"array_remove(array({', '.join(f'if(getbit({word}, {i}) = 1, {i}, -1)' for i in range(n))}), -1)"
    if len(checks) <= BITS:
        hit = flagged.withColumn("number of check", F.expr(f"explode(if(`open of row` AND `words of row`[0] != 0, {bits('`words of row`[0]', len(checks))}, NULL))"))
    else:
        words = "filter(transform(`words of row`, (w, i) -> struct(w AS word, i AS at)), x -> x.word != 0)"
        full = flagged.withColumn("word of row", F.expr(f"explode(if(`open of row` AND exists(`words of row`, w -> w != 0), {words}, NULL))"))
        hit = full.withColumn("bit of word", F.expr(f"explode({bits('`word of row`.word', BITS)})")).withColumn("number of check", F.expr(f"`word of row`.at * {BITS} + `bit of word`"))
    values: dict[str, tuple[Column, list[int]]] = {}  # checks that show the same value share it
    for i, c in enumerate(checks):
        values.setdefault(c.field if c.value is None else f"value of check {i}", (c.shown, []))[1].append(i)
    which = {i: k for k, (_, own) in enumerate(values.values()) for i in own}
    # what checks say, as constants
    told = lambda cells, kind="string": F.get(F.from_json(F.lit(json.dumps(cells)), f"array<{kind}>"), F.col("number of check"))
    of = lambda name: told([getattr(c, name) for c in checks]) if len({getattr(c, name) for c in checks}) > 1 else F.lit(getattr(checks[0], name))
    hit = hit.withColumn("shown of check", told([which[i] for i in range(len(checks))], "int"))
    nth = F.col("shown of check")
    shown = F.when(~_apart(nth), F.lit("")) if len(values) > FEW else F.when(nth < 0, F.lit(""))
    for k, (value, _) in enumerate(values.values()):
        shown = shown.when(nth == k, value.cast("string"))
    found = issue_struct(
        row=F.col(row) if row else None, value=shown, field_code=told([c.code or c.field for c in checks]), field_label=of("label"), dpm_reference=of("reference"),
        **{n: of(n) for n in ("rule_id", "rule_level", "rule_type", "template", "severity", "message", "explanation")},
    )
    return hit.select(*keys, *[found[n].alias(n) for n in ISSUE_COLUMNS])


def present(field: str) -> Column:
    """Shared too: the check has to name ``missing`` of the field in ``needs``."""
    return ~missing(field)


def mandatory(rule_id: str, field: str, condition: Column | None = None, **how) -> Check:
    """Filled wherever the condition holds."""
    empty = missing(field)
    return Check(rule_id, field, empty if condition is None else condition & empty, value=F.lit(""), **{"rule_type": "MANDATORY", "needs": needs(missing=field)} | how)


def format_check(rule_id: str, field: str, good: Column, value: Column | None = None, **how) -> Check:
    """A present value must be ``good``."""
    return Check(rule_id, field, present(field) & ~F.coalesce(good, F.lit(False)), value=value, **{"rule_type": "FORMAT", "needs": needs(missing=field)} | how)


def codelist(rule_id: str, field: str, values: Sequence[str], **how) -> Check:
    """The stripped value, with its case, is in the list; for lists of literal size."""
    allowed = sorted({*values, *ALWAYS_ALLOWED})
    shown = ", ".join(sorted(values)[:10]) + "..." * (len(values) > 10)
    return format_check(rule_id, field, P.stripped(F.col(field)).isin(*allowed), **{"rule_type": "CODELIST_CHECK", "explanation": f"allowed: {shown}"} | how)


def isin_if_typed(rule_id: str, field: str, type_field: str | None, **how) -> Check:
    """An ISIN, where the type column says ISIN; everywhere if no type column is named or the table lacks it."""
    c = format_check(rule_id, field, P.is_isin(F.col(field)), **how)
    if type_field is None:
        return c
    typed = absent(type_field) | F.upper(F.col(type_field)).contains("ISIN")
    return Check(**{**c.__dict__, "failed": c.failed & typed, "needs": (*c.needs, *needs(absent=type_field))})


def compare(rule_id: str, field: str, bad: Column, **how) -> Check:
    """``bad`` over numbers that are null where they do not parse: those rows pass."""
    return Check(rule_id, field, present(field) & F.coalesce(bad, F.lit(False)), **{"rule_type": "NUMERIC", "needs": needs(missing=field, grouped=field)} | how)


def greater_zero(rule_id: str, field: str, **how) -> Check:
    return compare(rule_id, field, derived("grouped", field) <= 0, **how)


def not_negative(rule_id: str, field: str, **how) -> Check:
    return compare(rule_id, field, derived("grouped", field) < 0, **how)


def equal_zero(rule_id: str, field: str, tolerance: float = 0.01, **how) -> Check:
    return compare(rule_id, field, F.abs(derived("grouped", field)) > tolerance, **how)


def integer_text(rule_id: str, field: str, **how) -> Check:
    """Can be cut to an integer; always a warning."""
    return format_check(rule_id, field, P.is_integer_text(F.col(f"`{field}`")), **{"rule_type": "FORMAT"} | how | {"severity": WARNING})


def whole_from_one(rule_id: str, field: str, **how) -> Check:
    """An integer from 1; what is no finite number fails."""
    n = derived("grouped", field)
    return compare(rule_id, field, n.isNull() | (n < 1) | ~P.is_finite(n) | (n != F.floor(n)), **how)


def not_reported(rule_id: str, field: str, **how) -> Check:
    """Any value that is not missing is a finding."""
    return Check(rule_id, field, present(field), **{"rule_type": "NOT_APPLICABLE", "needs": needs(missing=field)} | how)


def sum_formula(rule_id: str, result: str, terms: Sequence[tuple[int, str]], tolerance: float = 1.0, floor_zero: bool = False, **how) -> Check:
    """result = sum of signed terms, or at least zero of it; rows with a missing or unparsable operand pass."""
    total = reduce(lambda a, b: a + b, [F.lit(float(s)) * derived("grouped", f) for s, f in terms])
    expected = F.greatest(F.lit(0.0), total) if floor_zero else total
    expected = F.when(reduce(lambda a, b: a & b, [present(f) for _, f in terms]) & total.isNotNull(), expected)
    got = derived("grouped", result)
    fields = [result, *[f for _, f in terms]]
    shown = F.concat(F.format_number(got, 2), F.lit(" (expected: "), F.format_number(expected, 2), F.lit(")"))
    return compare(rule_id, result, F.abs(got - expected) > tolerance, value=shown, **{"severity": WARNING, "rule_type": "FORMULA", "needs": needs(missing=fields, grouped=fields)} | how)


def gated(check: Check, condition: Val) -> Check:
    """The check where the condition is evaluated and true; a row whose condition fails, as for want of a column, is passed over.

    A condition on another table's row names the column that ``cross.aligned`` has added.
    """
    return Check(**{**check.__dict__, "failed": holds(condition) & F.coalesce(check.failed, F.lit(False)), "needs": (*check.needs, *condition.needs)})


def conditional_mandatory(rule_id: str, field: str, on: str, operator: str, given: str | None = None, **how) -> Check:
    """Filled where the condition column equals or differs from ``given``, is missing, or is not; a table without that column passes."""
    c = P.stripped(F.col(on))
    trigger = {"eq": present(on) & (c == F.lit(given)), "neq": present(on) & (c != F.lit(given)), "not_missing": present(on), "missing": ~present(on)}[operator]
    return Check(rule_id, field, ~absent(on) & trigger & missing(field), value=F.lit("<empty>"), **{"severity": WARNING, "rule_type": "CONDITIONAL_MANDATORY", "needs": needs(missing=[field, on], absent=on)} | how)


def plausibility(rule_id: str, operator: str, field: str, field2: str | None = None, field3: str | None = None, low: float = 0.0, high: float | None = None, **how) -> Check:
    """Numbers with decimal commas; a null operand lets the row pass."""
    v, v2, v3 = (derived("decimal", f) if f else None for f in (field, field2, field3))
    if operator == "lte":
        bad = v > v2
    elif operator == "sum_lte":
        bad = v + v2 > v3
    elif operator == "gte_zero_if":
        bad = present(field2) & (v < 0)
    elif operator == "gt_zero_if":
        bad = present(field2) & (v <= 0)
    elif operator in ("gt_zero", "gt_zero_if_present"):
        bad = v <= 0
    elif operator == "gte_zero":
        bad = v < 0
    elif operator == "equals_diff":
        bad = F.abs(v - (v2 - v3)) > 0.01
    elif operator == "opposite_sign_or_zero":
        bad = ((v2 > 0) & (v > 0)) | ((v2 < 0) & (v < 0))
    elif operator == "range_exclusive_min":
        bad = ~((v > low) & ((v <= high) if high is not None else F.lit(True)))
    else:
        raise ValueError(f"unknown plausibility operator {operator!r}")
    return Check(rule_id, field, bad, **{"severity": WARNING, "rule_type": "PLAUSIBILITY", "needs": needs(missing=field2, decimal=[field, field2, field3])} | how)


def date_order(rule_id: str, field: str, operator: str, other: Column | str, **how) -> Check:
    """``lte`` or ``gte`` another date (a reference date, or that of the column of this name); null on either side passes."""
    d, e = derived("day", field), derived("day", other) if isinstance(other, str) else other
    return Check(rule_id, field, d > e if operator == "lte" else d < e, **{"severity": WARNING, "rule_type": "DATE", "needs": needs(day=[field, other if isinstance(other, str) else None])} | how)


def identifier_format(rule_id: str, field: str, kind: str, **how) -> Check:
    """Loose forms: ISIN, LEI without folding case, two-letter country, BIC."""
    c = F.col(field)
    good = {"ISIN": P.is_isin(c, strict=False), "LEI": P.is_lei(c, fold_case=False), "ISO3166_ALPHA2": P.is_country(c, listed=False), "BIC": P.is_bic(c)}[kind]
    return format_check(rule_id, field, good, **{"severity": WARNING} | how)


def implies(rule_id: str, field: str, condition: Column, bad: Column, **how) -> Check:
    """If the condition holds, ``bad`` must not."""
    return Check(rule_id, field, condition & bad, **{"severity": WARNING, "rule_type": "BUSINESS"} | how)


def codelist_join(df: DataFrame, field: str, allowed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Codelist membership against a table of (value): for lists too long for literals."""
    value = P.stripped(F.col(field))
    rows = df.where(~P.is_missing(F.col(field)) & ~value.isin(*ALWAYS_ALLOWED)).select(*keys, value.alias("value"))
    return rows.join(allowed.select("value").distinct(), "value", "left_anti").select(*keys, "value")


def codelist_joins(df: DataFrame, fields: Sequence[tuple[str, str]], allowed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys`` with (rule_id, value, explanation) of values outside their lists, for many (rule_id, field) at once.

    ``allowed`` is (rule_id, value); a rule without values is not checked.  All
    cells go through one join, against a table that Spark broadcasts or not by
    its size.
    """
    cell = lambda rule, f: F.when(~P.is_missing(F.col(f"`{f}`")) & ~P.stripped(F.col(f"`{f}`")).isin(*ALWAYS_ALLOWED), F.struct(F.lit(rule).alias("rule_id"), P.stripped(F.col(f"`{f}`")).alias("value")))
    cells = df.select(*keys, F.explode(F.array(*[cell(r, f) for r, f in fields])).alias("cell")).where("cell is not null").select(*keys, "cell.*")
    values = allowed.where(F.col("rule_id").isin(*[r for r, _ in fields])).select("rule_id", P.stripped(F.col("value")).alias("value")).distinct()
    place = F.row_number().over(W.partitionBy("rule_id").orderBy("value"))
    first = values.withColumn("place", place).where("place <= 11").groupBy("rule_id").agg(F.array_sort(F.collect_list("value")).alias("first"))
    told = first.select("rule_id", F.concat(F.lit("allowed: "), F.array_join(F.slice("first", 1, 10), ", "), F.when(F.size("first") > 10, "...").otherwise("")).alias("explanation"))
    return cells.join(values, ["rule_id", "value"], "left_anti").join(told, "rule_id").select(*keys, "rule_id", "value", "explanation")


def columns_missing(df: DataFrame, checks: Sequence[Check]) -> list[Check]:
    """Mandatory checks whose column the table lacks; others of that kind are silently dropped by the caller."""
    return [c for c in checks if c.field not in df.columns and c.rule_type in ("MANDATORY", "MANDATORY_FIELD")]
