"""Checks over several rows or tables: keys, references, totals and aligned rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabguard.functions.predicates import grouped_double, is_missing, stripped
from tabguard.operators.checks import Check, compare, derived, missing, needs, present
from tabguard.operators.membership import bitmap_filter, fits_in_memory, probed
from tabguard.sources.scratch import kept, unused
from tabguard.sources.tables import resolve_column

# fixed values: texts that stand for no reference
SKIPPED_REFERENCES = ("Aggregated", "N/A", "Not applicable", "")
PLAIN_PRODUCTS = ("Non-structured/Vanilla", "", "Not available", "Not applicable")


def repeated_keys(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """Every row of a key after its first in ``order_by`` (a total order), with its ``occurrence``.

    Rows with a missing key part are skipped; key columns that the table lacks
    are left out of the key.  Only keys that occur twice are looked at further.
    These rows are written in ranges of key and order, so that a key which holds
    a third of all rows is many tasks; the rows of a key in the ranges before
    give the rest of its numbers.
    """
    own = [k for k in keys if k in df.columns]
    if not own:
        return df.limit(0).withColumn("occurrence", F.lit(1))
    rows = df
    for k in own:
        rows = rows.where(~is_missing(F.col(k).cast("string")))
    spark = df.sparkSession
    range_, nth, ahead = (unused(df, n) for n in ("range", "nth", "before"))
    # once written their size is known, and few keys are broadcast by Spark itself: then only the keys are shuffled
    twice = kept(rows.groupBy(*own).agg(F.count("*").alias(nth)).where(F.col(nth) > 1).select(*own), "repeated-keys")
    if twice.isEmpty():
        return df.limit(0).withColumn("occurrence", F.lit(1))
    ranges = rows.join(twice, own, "left_semi").repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *own, *order_by)
    placed = kept(ranges.withColumn(range_, F.spark_partition_id()), "repeated-rows")
    sizes = placed.groupBy(*own, range_).agg(F.count("*").alias(nth))
    before = F.coalesce(F.sum(nth).over(W.partitionBy(*own).orderBy(range_).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row for each range of a key
    number = F.row_number().over(W.partitionBy(*own, range_).orderBy(*order_by))
    numbered = placed.withColumn(nth, number).join(sizes.select(*own, range_, before.alias(ahead)), [*own, range_])
    return numbered.select(*df.columns, (F.col(nth) + F.col(ahead)).cast("int").alias("occurrence")).where("occurrence > 1")


def _total(df: DataFrame, amount: Column, name: str) -> DataFrame:
    filled, n = ~is_missing(amount), grouped_double(amount)
    return df.agg(F.coalesce(F.sum(F.when(filled, n)), F.lit(0.0)).alias(name), F.count_if(filled & n.isNull()).alias(f"{name}_bad"))


def _both(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row with the totals of both; each side is a scalar subquery."""
    side = lambda df, name: df.select(F.struct(name, f"{name}_bad")).scalar().alias(name)
    one = a.sparkSession.range(1).select(side(a, "total_a"), side(b, "total_b"))
    return one.select(*[F.col(f"{n}.{m}").alias(m) for n in ("total_a", "total_b") for m in (n, f"{n}_bad")])


def totals_differ(a: DataFrame, a_field: str, b: DataFrame, b_field: str, tolerance: float = 1.0) -> DataFrame:
    """(total_a, total_b) if the sums differ by more than the tolerance; a value that does not parse disables the check."""
    both = _both(_total(a, F.col(a_field), "total_a"), _total(b, F.col(b_field), "total_b"))
    return both.where((F.col("total_a_bad") == 0) & (F.col("total_b_bad") == 0) & (F.abs(F.col("total_a") - F.col("total_b")) > tolerance)).select("total_a", "total_b")


def conditional_totals_differ(a: DataFrame, a_field: str, b: DataFrame, b_field: str, category: str, categories: Sequence[str], share: float = 0.05) -> DataFrame:
    """Sum of a without zeros against the sum of b's listed categories, relative to a; only if both are above zero."""
    left = _total(a.where(~stripped(F.col(a_field)).isin("0", "0.0")), F.col(a_field), "total_a")
    right = _total(b.where(stripped(F.col(category)).isin(*categories)), F.col(b_field), "total_b")
    bad = (F.col("total_a_bad") == 0) & (F.col("total_b_bad") == 0) & (F.col("total_a") > 0) & (F.col("total_b") > 0)
    return _both(left, right).where(bad & (F.abs(F.col("total_a") - F.col("total_b")) > share * F.col("total_a"))).select("total_a", "total_b")


def _values(df: DataFrame, field: str, keep: Sequence[str] = ()) -> DataFrame:
    """``keep`` and the stripped text of a field as ``value``, where it is not missing."""
    text = F.col(f"`{field}`").cast("string")
    return df.where(~is_missing(text)).select(*keep, stripped(text).alias("value"))


def unmatched(child: DataFrame, field: str, parent: DataFrame, parent_field: str, keep: Sequence[str], skip: Sequence[str] = (), filtered: bool | None = None) -> DataFrame:
    """Child rows whose value no parent row has; missing and skipped values pass.

    Spark broadcasts the parents if they are below its threshold.  If they are
    not (``filtered`` says so otherwise), a bounded bitmap of their hashes is
    broadcast first: rows that it rules out are findings without a shuffle, and
    only the others are shuffled with the parents, AQE splitting frequent values.
    """
    rows = _values(child, field, keep)
    if skip:
        rows = rows.where(~F.col("value").isin(*skip))
    there = _values(parent, parent_field)
    if not (not fits_in_memory(there) if filtered is None else filtered):
        return rows.join(there.distinct(), "value", "left_anti").select(*keep, "value")
    name = unused(rows, "may match")
    told = probed(rows, "value", bitmap_filter(there, "value"), name)
    known = told.where(~F.col(f"`{name}`")).select(*keep, "value")
    return known.unionByName(told.where(F.col(f"`{name}`")).join(there.distinct(), "value", "left_anti").select(*keep, "value"))


def unmatched_references(child: DataFrame, field: str, parent: DataFrame, parent_field: str, keep: Sequence[str], filtered: bool | None = None) -> DataFrame:
    return unmatched(child, field, parent, parent_field, keep, SKIPPED_REFERENCES, filtered)


def overlapping(a: DataFrame, b: DataFrame, field: str, keep: Sequence[str], filtered: bool | None = None) -> DataFrame:
    """Rows of b whose id a has too: what must not be counted twice.  Rows that a bitmap of a's ids rules out are not shuffled (as in ``unmatched``)."""
    ids, rows = _values(a, field), _values(b, field, keep)
    if not fits_in_memory(ids) if filtered is None else filtered:
        name = unused(rows, "may match")
        rows = probed(rows, "value", bitmap_filter(ids, "value"), name).where(F.col(f"`{name}`"))
    return rows.join(ids.distinct(), "value", "left_semi").select(*keep, "value")


def counted_twice(tables: Mapping[str, DataFrame], base: str, field: str, keep: Sequence[str]) -> DataFrame | None:
    """Overlap of a table's two submissions: ids of ``_TypeB`` that ``_TypeA`` has, or the plain table where there is no ``_TypeA``.

    None where a side, or the field in one of them, was not delivered.
    """
    a, b = tables.get(f"{base}_TypeA", tables.get(base)), tables.get(f"{base}_TypeB")
    if a is None or b is None:
        return None
    in_a, in_b = resolve_column(a, field), resolve_column(b, field)
    if in_a is None or in_b is None:
        return None
    return overlapping(a.select(F.col(f"`{in_a}`").alias(in_b)), b, in_b, keep)


def needs_table(tables: Mapping[str, DataFrame], df: DataFrame, field: str, contains: str, names: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Rows that speak of something for which none of the named tables is loaded."""
    if any(n in tables for n in names):
        return df.limit(0).select(*keep, F.col(field).alias("value"))
    return df.where(F.col(field).contains(contains)).select(*keep, F.col(field).alias("value"))


def rank_check(rule_id: str, field: str, **how) -> Check:
    """A non-negative integer; a fraction is cut first, so -0.5 passes."""
    n = derived("grouped", field)
    return compare(rule_id, field, n.isNull() | (n <= -1), **how)


def derived_amount(rule_id: str, total: str, base: str, extra: str, kind: str | None, tolerance: float = 1.0, **how) -> Check:
    """total = base + extra (missing: 0) for plain products."""
    plain = F.lit(True) if kind is None else F.when(missing(kind), F.lit("")).otherwise(stripped(F.col(kind))).isin(*PLAIN_PRODUCTS)
    more = F.when(missing(extra), F.lit(0.0)).otherwise(derived("grouped", extra))
    base_n = F.when(present(base), derived("grouped", base))
    fields = [total, base, extra]
    return compare(rule_id, total, plain & (F.abs(derived("grouped", total) - (base_n + more)) > tolerance), **{"needs": needs(missing=[*fields, kind], grouped=fields)} | how)


def category_needs_field(rule_id: str, category: str, contains: str, field: str, columns: Sequence[str], **how) -> Check:
    """A category that contains the text needs the field; a table without the column lacks it everywhere."""
    empty = missing(field) if field in columns else F.lit(True)
    return Check(rule_id, category, F.col(category).contains(contains) & empty, **{"rule_type": "CROSS", "needs": needs(missing=field if field in columns else None)} | how)


def aligned(left: DataFrame, right: DataFrame, right_field: str, row: str = "row", name: str = "other") -> DataFrame:
    """Add the right table's value of the same row number; beyond its end, that of its first row; blank is null.

    A flag of presence, not the value, decides, so that a null in an existing
    row stays null.
    """
    value = F.col(f"`{right_field}`")
    place, own, there = (unused(left, n) for n in ("right row", "right value", "right there"))
    other = right.select(F.col(row).alias(place), value.alias(own), F.lit(True).alias(there))
    first = right.agg(F.min_by(value, F.col(row))).scalar()
    v = F.when(F.col(f"`{there}`"), F.col(f"`{own}`")).otherwise(first)
    return left.join(other, left[row] == other[place], "left").withColumn(name, F.when(stripped(v) != "", v)).drop(place, own, there)


def first_seen(df: DataFrame, unique: Mapping[str, Sequence[str]], dependent: Mapping[str, tuple[str, str]], order_by: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """``keep``, rule_id, key and value, first_value of rows after the first of their key that must not be there.

    ``unique`` names key columns by rule: every later row of a key is a finding.
    ``dependent`` names a key and a value column by rule: later rows with another
    value than the first are.  Rows with a missing part are passed over; key
    columns that the table lacks are left out.  All rules share one aggregate of
    (rule, key), with partial counts before its shuffle, in which ``order_by`` (a
    total order) finds the first row; only keys with a finding are joined back,
    by a table whose size is known, so that few are broadcast and the rows are
    not shuffled at all.
    """
    text = lambda f: F.col(f"`{f}`").cast("string")
    filled = lambda fs: reduce(lambda a, b: a & b, [~is_missing(text(f)) for f in fs])
    cells = []
    for rule, fields in unique.items():
        own = [f for f in fields if f in df.columns]
        if own:
            framed = F.to_json(F.array(*[stripped(text(f)) for f in own]))
            cells.append(F.when(filled(own), F.struct(F.lit(rule).alias("rule_id"), framed.alias("key"), F.lit(None).cast("string").alias("value"))))
    for rule, (key, value) in dependent.items():
        if key in df.columns and value in df.columns:
            cells.append(F.when(filled([key, value]), F.struct(F.lit(rule).alias("rule_id"), stripped(text(key)).alias("key"), stripped(text(value)).alias("value"))))
    names = {n: unused(df, n) for n in ("cell", "order")}
    if not cells:
        return df.limit(0).select(*keep, *[F.lit("").alias(n) for n in ("rule_id", "key", "value", "first_value")])
    rows = df.select(*keep, F.struct(*order_by).alias(names["order"]), F.explode(F.array(*cells)).alias(names["cell"])).where(F.col(f"`{names['cell']}`").isNotNull())
    rule, key, value = (F.col(f"`{names['cell']}`.{n}") for n in ("rule_id", "key", "value"))
    order = F.col(f"`{names['order']}`")
    firsts = rows.groupBy(rule.alias("rule_id"), key.alias("key")).agg(F.count("*").alias("n"), F.min(order).alias("first_at"), F.min_by(value, order).alias("first_value"), F.min(value).alias("low"), F.max(value).alias("high"))
    found = kept(firsts.where(F.when(F.col("low").isNull(), F.col("n") > 1).otherwise(F.col("low") != F.col("high"))).select("rule_id", "key", "first_at", "first_value"), "first-seen")
    joined = rows.join(found, (rule == found["rule_id"]) & (key == found["key"]))
    later = F.when(value.isNull(), order > found["first_at"]).otherwise(value != found["first_value"])
    return joined.where(later).select(*keep, found["rule_id"], found["key"], value.alias("value"), found["first_value"])
