"""Named business rules: parameter sets of "if this then not that".

A table that lacks a rule's condition column passes it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabguard.functions.predicates import is_missing, stripped
from tabguard.operators.checks import Check, derived, implies, missing, needs
from tabguard.sources.scratch import unused


def _n(field: str) -> Column:
    return derived("decimal", field)


def _is(field: str, text: str) -> Column:
    return stripped(F.col(field)) == text


def _empty(field: str) -> Column:
    return missing(field)


def structural_subordination_rank(flag: str = "c0160", rank: str = "c0170") -> Check:
    return implies("structural_subordination_rank", rank, _is(flag, "1"), _empty(rank), needs=needs(missing=[rank, flag]))


def own_funds_rank_check(kind: str = "c0060", rank: str = "c0170") -> Check:
    return implies("own_funds_rank_check", rank, stripped(F.col(kind)).isin("T1", "T2", "AT1"), _empty(rank), needs=needs(missing=[rank, kind]))


def zero_coupon_accruals(rate: str = "c0110", accrued: str = "c0220") -> Check:
    return implies("zero_coupon_accruals", accrued, _n(rate) == 0, _n(accrued) != 0, needs=needs(decimal=[rate, accrued]))


def non_structured_fields_empty(flag: str, fields: Sequence[str]) -> list[Check]:
    """One finding for each filled field."""
    return [implies("non_structured_fields_empty", f, _is(flag, "0"), ~_empty(f), needs=needs(missing=[f, flag])) for f in fields]


def unsecured_no_collateral(flag: str = "c0300", collateral: str = "c0310") -> Check:
    return implies("unsecured_no_collateral", collateral, _is(flag, "0"), ~_empty(collateral), needs=needs(missing=[collateral, flag]))


def securities_count_consistency(amount: str = "c0410", count: str = "c0420") -> Check:
    return implies("securities_count_consistency", count, _n(amount) > 0, _n(count) == 0, needs=needs(decimal=[amount, count]))


def ccp_cleared_stay_na(flag: str = "c0380", stay: str = "c0390") -> Check:
    return implies("ccp_cleared_stay_na", stay, _is(flag, "1"), ~_empty(stay), needs=needs(missing=[stay, flag]))


def carrying_amount_plausibility(carrying: str = "c0070", principal: str = "c0080", factor: float = 1.5) -> Check:
    return implies("carrying_amount_plausibility", carrying, _n(principal) > 0, F.abs(_n(carrying)) > factor * _n(principal), needs=needs(decimal=[principal, carrying]))


def eur_exchange_rate_positive(rate: str = "c0060") -> Check:
    return implies("eur_exchange_rate_positive", rate, F.lit(True), _n(rate) <= 0, needs=needs(decimal=rate))


def eur_currency_rate_one(currency: str = "c0020", rate: str = "c0060") -> Check:
    return implies("eur_currency_rate_one", rate, F.upper(stripped(F.col(currency))) == "EUR", F.abs(_n(rate) - 1) > 0.0001, needs=needs(decimal=rate, missing=currency))


def first_value_conflicts(df: DataFrame, key: str, value: str, order_by: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Rows whose value differs from the first one of their key (a functional dependency).

    ``order_by`` must be a total order.  Keys with a single value never reach
    the window: the first value is found by a partial aggregate and joined.
    """
    rows = df.where(~is_missing(F.col(key)) & ~is_missing(F.col(value)))
    order = F.struct(*order_by)
    own, first = unused(df, "key of row"), unused(df, "first of key")
    firsts = rows.groupBy(F.col(key).alias(own)).agg(F.min_by(value, order).alias(first), F.min(value).alias("low"), F.max(value).alias("high")).where("low <> high").select(own, first)
    return rows.join(firsts, rows[key] == firsts[own]).where(rows[value] != firsts[first]).select(*keep, key, F.col(value).alias("value"), F.col(first).alias("first_value"))
