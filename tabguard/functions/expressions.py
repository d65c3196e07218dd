"""Values of conditions and assertions: a value and whether its evaluation failed.

Null is a value here (false where a truth is asked for); a failed evaluation is
something else and lets the row be skipped.  Every function takes and returns
``Val``; plain Columns of text stand for values that cannot fail.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabguard.functions.predicates import grouped_double, stripped


@dataclass(frozen=True)
class Val:
    value: Column
    err: Column
    kind: str = "text"  # text, number or truth
    needs: tuple[tuple[str, str], ...] = ()  # what ``checks.fuse`` has to supply


def text(c: Column) -> Val:
    return Val(c, F.lit(False))


def field(name: str) -> Val:
    """A column of the table that is checked; where the table lacks it, evaluation fails."""
    return Val(F.col(f"`{name}`"), F.col(f"`absent of {name}`"), needs=(("absent", name),))


def _needs(*parts: Val) -> tuple[tuple[str, str], ...]:
    return tuple(n for p in parts for n in p.needs)


def truth(c: Column, *parts: Val) -> Val:
    return Val(F.coalesce(c, F.lit(False)), reduce(lambda a, b: a | b, [p.err for p in parts], F.lit(False)), "truth", _needs(*parts))


def num(v: Val) -> Column:
    return v.value.cast("double") if v.kind != "text" else grouped_double(v.value)


def _text(v: Val) -> Column:
    return v.value.cast("string")


def _fold(c: Column) -> Column:
    return F.replace(F.lower(stripped(c)), F.lit("ß"), F.lit("ss"))


def _same(a: Val, b: Val) -> Column:
    x, y = num(a), num(b)
    both = F.when(x.isNotNull() & y.isNotNull(), x == y).otherwise(_fold(_text(a)) == _fold(_text(b)))
    return F.when(a.value.isNull() | b.value.isNull(), a.value.isNull() & b.value.isNull()).otherwise(both)


def equality_key(v: Val) -> Column:
    """A text that two values share exactly where they are equal; null of null.

    Equal texts parse to equal numbers, so a number's key is the number, that of
    any other text its folded form.
    """
    number = num(v)
    return F.when(number.isNotNull(), F.concat(F.lit("n"), (number + F.lit(0.0)).cast("string"))).otherwise(F.concat(F.lit("t"), _fold(_text(v))))


def eq(a: Val, b: Val) -> Val:
    """Null equals null alone; numbers as numbers, other texts without case and outer white space."""
    return truth(_same(a, b), a, b)


def ne(a: Val, b: Val) -> Val:
    return truth(~_same(a, b), a, b)


def _order(a: Val, b: Val, op: str) -> Val:
    x, y = num(a), num(b)
    ops = {"lt": lambda p, q: p < q, "le": lambda p, q: p <= q, "gt": lambda p, q: p > q, "ge": lambda p, q: p >= q}
    return truth(F.when(x.isNotNull() & y.isNotNull(), ops[op](x, y)).otherwise(ops[op](_text(a), _text(b))), a, b)


def lt(a: Val, b: Val) -> Val:
    """Null on either side is false; texts compare with their case."""
    return _order(a, b, "lt")


def le(a: Val, b: Val) -> Val:
    return _order(a, b, "le")


def gt(a: Val, b: Val) -> Val:
    return _order(a, b, "gt")


def ge(a: Val, b: Val) -> Val:
    return _order(a, b, "ge")


def is_in(a: Val, items: list[Val]) -> Val:
    """Null on the left is in nothing."""
    return truth(a.value.isNotNull() & reduce(lambda p, q: p | q, [_same(a, i) for i in items], F.lit(False)), a, *items)


def not_in(a: Val, items: list[Val]) -> Val:
    """Nor is it not in anything."""
    return truth(a.value.isNotNull() & ~reduce(lambda p, q: p | q, [_same(a, i) for i in items], F.lit(False)), a, *items)


def add(a: Val, b: Val) -> Val:
    """The sum of two numbers as text, or the texts one after the other (null adds nothing)."""
    x, y = num(a), num(b)
    joined = F.concat(F.coalesce(_text(a), F.lit("")), F.coalesce(_text(b), F.lit("")))
    return Val(F.when(x.isNotNull() & y.isNotNull(), (x + y).cast("string")).otherwise(joined), a.err | b.err, needs=_needs(a, b))


def _arithmetic(value: Column, *parts: Val) -> Val:
    bad = reduce(lambda p, q: p | q, [p.err | num(p).isNull() for p in parts])
    return Val(value, bad | value.isNull(), "number", _needs(*parts))


def sub(a: Val, b: Val) -> Val:
    return _arithmetic(num(a) - num(b), a, b)


def mul(a: Val, b: Val) -> Val:
    return _arithmetic(num(a) * num(b), a, b)


def div(a: Val, b: Val) -> Val:
    """Division by zero fails."""
    return _arithmetic(F.try_divide(num(a), num(b)), a, b)


def neg(a: Val) -> Val:
    return _arithmetic(-num(a), a)


def truthy(v: Val) -> Column:
    """Null is false, a text is true unless blank, a number unless zero."""
    if v.kind == "truth":
        return F.coalesce(v.value, F.lit(False))
    if v.kind == "number":
        return F.coalesce(v.value != 0, F.lit(False))
    return F.coalesce(stripped(v.value) != "", F.lit(False))


def and_(a: Val, b: Val) -> Val:
    """The right side can fail only where the left is true."""
    return Val(truthy(a) & truthy(b), a.err | (truthy(a) & b.err), "truth", _needs(a, b))


def or_(a: Val, b: Val) -> Val:
    return Val(truthy(a) | truthy(b), a.err | (~truthy(a) & b.err), "truth", _needs(a, b))


def not_(a: Val) -> Val:
    return Val(~truthy(a), a.err, "truth", a.needs)


def is_null(a: Val) -> Val:
    """Null or blank; 'N/A' is a value."""
    blank = stripped(a.value) == "" if a.kind == "text" else F.lit(False)
    return Val(a.value.isNull() | F.coalesce(blank, F.lit(False)), a.err, "truth", a.needs)


def is_not_null(a: Val) -> Val:
    return not_(is_null(a))


is_reported = is_not_null


def abs_(a: Val) -> Val:
    return _arithmetic(F.abs(num(a)), a)


def least(*parts: Val) -> Val:
    """Fails where an argument is no number."""
    return _arithmetic(F.least(*map(num, parts)) if len(parts) > 1 else num(parts[0]), *parts)


def greatest(*parts: Val) -> Val:
    return _arithmetic(F.greatest(*map(num, parts)) if len(parts) > 1 else num(parts[0]), *parts)


def length(a: Val) -> Val:
    return Val(F.coalesce(F.length(_text(a)), F.lit(0)), a.err, "number", a.needs)


def lower(a: Val) -> Val:
    return Val(F.lower(F.coalesce(_text(a), F.lit(""))), a.err, needs=a.needs)


def upper(a: Val) -> Val:
    return Val(F.upper(F.coalesce(_text(a), F.lit(""))), a.err, needs=a.needs)


def holds(condition: Val) -> Column:
    """Where the condition is evaluated and true."""
    return ~condition.err & truthy(condition)


def violated(condition: Val | None, assertion: Val | None) -> Column:
    """Where the condition holds and the assertion does not; failed evaluations are skipped.

    No condition means always, no assertion never.
    """
    if assertion is None:
        return F.lit(False)
    broken = ~assertion.err & ~truthy(assertion)
    return broken if condition is None else holds(condition) & broken
