"""Queries of the scalar predicates, the row checks and the business rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabguard.functions import expressions as E
from tabguard.functions import predicates as P
from tabguard.operators import business as B
from tabguard.operators import checks as C
from tabguard.operators import cross as X
from tabguard.queries.views import ORDERS_SQL, date, decimal, dirty_orders, grouped, listed, miss, num, strip

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

COLS = ("id", "rule_id", "field_code", "severity", "value")
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED")


def value_query(name: str, sql: str, **columns: Callable[[], Column]) -> None:
    QUERIES[name] = lambda s, d: dirty_orders(s, d).select("id", *[c().alias(n) for n, c in columns.items()])
    ORACLE[name] = f"SELECT id, {sql} FROM {ORDERS_SQL} AS t"


def finding_sql(rule_id: str, field: str, severity: str, where: str, value: str | None = None) -> str:
    shown = f"substr(coalesce({value if value is not None else field}, ''), 1, 200)"
    return f"SELECT id, '{rule_id}' AS rule_id, '{field}' AS field_code, '{severity}' AS severity, {shown} AS value FROM {ORDERS_SQL} AS t WHERE {where}"


def check_query(name: str, *parts: tuple) -> None:
    """Of each check: how it is made, "rule field severity", its SQL condition and perhaps the SQL of its value.

    One fused scan is held against a union of single queries.
    """
    QUERIES[name] = lambda s, d: C.fuse(dirty_orders(s, d), [p[0]() for p in parts], keys=["id"]).select(*COLS)
    ORACLE[name] = " UNION ALL ".join(finding_sql(*p[1].split(), *p[2:]) for p in parts)


def build() -> None:
    c = F.col
    filled = lambda f: f"NOT {miss(f)}"
    full = lambda f, p: f"regexp_full_match({f}, '{p}')"
    value_query("p01_is_missing", f"{miss('amount')} AS missing, {miss('day')} AS missing_day", missing=lambda: P.is_missing(c("amount")), missing_day=lambda: P.is_missing(c("day")))
    value_query("p02_blank_to_null", "CASE WHEN amount IN ('', 'None', 'nan') THEN NULL ELSE amount END AS v", v=lambda: P.blank_to_null(c("amount")))
    value_query("p03_decimal_comma_double", f"{decimal('amount')} AS v, {decimal('amount2')} AS w", v=lambda: P.decimal_comma_double(c("amount")), w=lambda: P.decimal_comma_double(c("amount2")))
    value_query("p04_grouped_double", f"{grouped('amount')} AS v, {grouped('amount2')} AS w", v=lambda: P.grouped_double(c("amount")), w=lambda: P.grouped_double(c("amount2")))
    numeric = num("replace(replace(amount, ' ', ''), ',', '')")
    value_query("p05_is_numeric", f"{numeric} IS NOT NULL AS v", v=lambda: P.is_numeric(c("amount")))
    value_query("p06_parse_date", f"CAST(datediff('day', DATE '1970-01-01', {date('day')}) AS INT) AS v, CAST(datediff('day', DATE '1970-01-01', {date('day2')}) AS INT) AS w", v=lambda: F.datediff(P.parse_date(c("day")), F.lit("1970-01-01").cast("date")), w=lambda: F.datediff(P.parse_date(c("day2")), F.lit("1970-01-01").cast("date")))
    iso = full("day", "[0-9]{4}-[0-9]{2}-[0-9]{2}(\\s[0-9]{2}:[0-9]{2}:[0-9]{2})?")
    value_query("p07_is_iso_date_text", f"{iso} AS v", v=lambda: P.is_iso_date_text(c("day")))
    value_query("p08_is_isin", f"{full('isin', '[A-Z]{2}[A-Z0-9]{9}[0-9]')} AS v, {full('isin', '[A-Z]{2}[A-Z0-9]{10}')} AS w", v=lambda: P.is_isin(c("isin")), w=lambda: P.is_isin(c("isin"), strict=False))
    value_query("p09_is_lei", f"{full('upper(lei)', '[0-9A-Z]{20}')} AS v, {full('lei', '[0-9A-Z]{20}')} AS w", v=lambda: P.is_lei(c("lei")), w=lambda: P.is_lei(c("lei"), fold_case=False))
    country = f"(upper(country) IN {listed(P.COUNTRIES)} OR {full('upper(country)', '[A-Z]{2}-[A-Z0-9]{1,3}')})"
    value_query("p10_is_country", f"{country} AS v, {full('country', '[A-Z]{2}')} AS w", v=lambda: P.is_country(c("country")), w=lambda: P.is_country(c("country"), listed=False))
    currency = f"(upper(currency) IN {listed(P.CURRENCIES)})"
    value_query("p11_is_currency", f"{currency} AS v", v=lambda: P.is_currency(c("currency")))
    bic = full("bic", "[A-Z]{4}[A-Z]{2}[A-Z0-9]{2}([A-Z0-9]{3})?")
    value_query("p12_is_bic", f"{bic} AS v", v=lambda: P.is_bic(c("bic")))
    boolean = f"(yesno IN {listed(P.BOOLEAN_TEXTS)})"
    value_query("p13_is_bool_text", f"{boolean} AS v", v=lambda: P.is_bool_text(c("yesno")))
    finite = lambda f: f"coalesce(isfinite({grouped(f)}), false)"
    value_query("p14_is_integer_text", f"{finite('amount')} AS v, {finite('big')} AS w", v=lambda: P.is_integer_text(c("amount")), w=lambda: P.is_integer_text(c("big")))
    value_query("p15_issue_value", "substr(coalesce(amount, ''), 1, 200) AS v", v=lambda: P.issue_value(c("amount")))

    check_query("r01_mandatory", (lambda: C.mandatory("r1", "amount"), "r1 amount ERROR", miss("amount"), "''"), (lambda: C.mandatory("r1c", "day", F.lower(c("category")).contains("urgent")), "r1c day ERROR", f"lower(category) LIKE '%urgent%' AND {miss('day')}", "''"))
    said = lambda *v: [E.text(F.lit(x)) for x in v]
    gate = lambda: E.and_(E.and_(E.eq(E.field("flag"), *said("1")), E.is_in(E.field("category"), said("1-URGENT", "2-HIGH"))), E.ne(E.field("idtype"), *said("CUSIP")))
    open_gate = f"flag = '1' AND lower({strip('category')}) IN ('1-urgent', '2-high') AND coalesce(lower({strip('idtype')}) <> 'cusip', true)"
    check_query(
        "r02_conditional_gate",
        (lambda: C.gated(C.mandatory("r2", "amount3"), gate()), "r2 amount3 ERROR", f"{open_gate} AND {miss('amount3')}", "''"),
        (lambda: C.gated(C.not_negative("r2n", "amount"), E.not_(gate())), "r2n amount ERROR", f"NOT ({open_gate}) AND {filled('amount')} AND {grouped('amount')} < 0"),
        (lambda: C.gated(C.mandatory("r2u", "amount"), E.eq(E.field("unheard of"), *said("1"))), "r2u amount ERROR", "false", "''"),
    )
    allowed = listed({*PRIORITIES, *C.ALWAYS_ALLOWED})
    check_query("r03_codelist", (lambda: C.codelist("r3", "category", PRIORITIES), "r3 category ERROR", f"{filled('category')} AND {strip('category')} NOT IN {allowed}"))
    check_query("r05_lei_format", (lambda: C.format_check("r5", "lei", P.is_lei(c("lei"))), "r5 lei ERROR", f"{filled('lei')} AND NOT {full('upper(lei)', '[0-9A-Z]{20}')}"))
    check_query("r06_country_format", (lambda: C.format_check("r6", "country", P.is_country(c("country"))), "r6 country ERROR", f"{filled('country')} AND NOT {country}"))
    check_query("r07_currency_format", (lambda: C.format_check("r7", "currency", P.is_currency(c("currency")), value=F.upper(c("currency"))), "r7 currency ERROR", f"{filled('currency')} AND NOT {currency}", "upper(currency)"))
    check_query("r08_numeric_type", (lambda: C.format_check("r8", "amount", P.is_numeric(c("amount"))), "r8 amount ERROR", f"{filled('amount')} AND {numeric} IS NULL"))
    check_query("r09_date_format", (lambda: C.format_check("r9", "day", P.is_iso_date_text(c("day"))), "r9 day ERROR", f"{filled('day')} AND NOT {iso}"))
    isin = full("isin", "[A-Z]{2}[A-Z0-9]{9}[0-9]")
    check_query("r10_isin_if_typed", (lambda: C.isin_if_typed("r10", "isin", "idtype"), "r10 isin ERROR", f"{filled('isin')} AND NOT {isin} AND upper(idtype) LIKE '%ISIN%'"), (lambda: C.isin_if_typed("r10all", "isin", None), "r10all isin ERROR", f"{filled('isin')} AND NOT {isin}"))
    g = grouped("amount")
    check_query("r11_greater_zero", (lambda: C.greater_zero("r11", "amount"), "r11 amount ERROR", f"{filled('amount')} AND {g} <= 0"))
    check_query("r12_not_negative", (lambda: C.not_negative("r12", "amount"), "r12 amount ERROR", f"{filled('amount')} AND {g} < 0"))
    check_query("r13_boolean_text", (lambda: C.format_check("r13", "yesno", P.is_bool_text(c("yesno"))), "r13 yesno ERROR", f"{filled('yesno')} AND NOT {boolean}"))
    check_query("r14_integer_text", (lambda: C.integer_text("r14", "amount"), "r14 amount WARNING", f"{filled('amount')} AND {g} IS NULL"), (lambda: C.integer_text("r14e", "big", severity="ERROR"), "r14e big WARNING", f"{filled('big')} AND NOT {finite('big')}"))
    check_query("r15_whole_from_one", (lambda: C.whole_from_one("r15", "amount"), "r15 amount ERROR", f"{filled('amount')} AND ({g} IS NULL OR {g} < 1 OR {g} <> floor({g}))"), (lambda: C.whole_from_one("r15b", "big"), "r15b big ERROR", f"{filled('big')} AND (NOT {finite('big')} OR {grouped('big')} < 1 OR {grouped('big')} <> floor({grouped('big')}))"))
    check_query("r16_not_reported", (lambda: C.not_reported("r16", "amount2"), "r16 amount2 ERROR", filled("amount2")))
    check_query("r17_equal_zero", (lambda: C.equal_zero("r17", "amount"), "r17 amount ERROR", f"{filled('amount')} AND abs({g}) > 0.01"))
    a, b, r = grouped("part_a"), grouped("part_b"), grouped("result")
    money = lambda x: f"format('{{:,.2f}}', {x})"
    both = f"{filled('result')} AND {filled('part_a')} AND {filled('part_b')}"
    check_query("r18_sum_formula", (lambda: C.sum_formula("r18", "result", [(1, "part_a"), (1, "part_b")]), "r18 result WARNING", f"{both} AND abs({r} - ({a} + {b})) > 1.0", f"{money(r)} || ' (expected: ' || {money(f'{a} + {b}')} || ')'"))
    floor = f"greatest(0.0, {b} - {a})"
    check_query("r19_floor_formula", (lambda: C.sum_formula("r19", "result", [(1, "part_b"), (-1, "part_a")], floor_zero=True), "r19 result WARNING", f"{both} AND abs({r} - {floor}) > 1.0", f"{money(r)} || ' (expected: ' || {money(floor)} || ')'"))
    cond = [("eq", f"{filled('flag')} AND {strip('flag')} = '1'"), ("neq", f"{filled('flag')} AND {strip('flag')} <> '1'"), ("not_missing", filled("amount2")), ("missing", miss("amount2"))]
    check_query("r20_conditional_mandatory", *[(lambda o=o: C.conditional_mandatory(f"r20{o}", "amount", "flag" if "eq" in o else "amount2", o, "1"), f"r20{o} amount WARNING", f"{w} AND {miss('amount')}", "'<empty>'") for o, w in cond])
    v, v2, v3 = decimal("amount"), decimal("amount2"), decimal("amount3")
    unheard = {"field2": "unheard of", "field3": "nor this"}
    check_query(
        "r21_absent_columns",
        *[(lambda o=o: C.plausibility(f"r21{o}", o, "amount", **unheard), f"r21{o} amount WARNING", "false") for o in ("lte", "sum_lte", "gte_zero_if", "gt_zero_if", "equals_diff", "opposite_sign_or_zero")],
        *[(lambda o=o: C.conditional_mandatory(f"r20{o}", "amount", "unheard of", o, "1"), f"r20{o} amount WARNING", "false") for o in ("eq", "neq", "not_missing", "missing")],
        (lambda: C.isin_if_typed("r10", "isin", "unheard of"), "r10 isin ERROR", f"{filled('isin')} AND NOT {isin}"),
        (lambda: C.date_order("r31", "day", "lte", "unheard of"), "r31 day WARNING", "false"),
        (lambda: C.sum_formula("r18", "result", [(1, "part_a"), (1, "unheard of")]), "r18 result WARNING", "false"),
        (lambda: B.unsecured_no_collateral("unheard of", "amount"), "unsecured_no_collateral amount WARNING", "false"),
    )
    for name, op, kw, where in (
        ("r21_lte", "lte", {"field2": "amount2"}, f"{v} > {v2}"),
        ("r22_sum_lte", "sum_lte", {"field2": "amount2", "field3": "amount3"}, f"{v} + {v2} > {v3}"),
        ("r23_gte_zero_if", "gte_zero_if", {"field2": "amount2"}, f"{filled('amount2')} AND {v} < 0"),
        ("r24_gt_zero_if", "gt_zero_if", {"field2": "amount2"}, f"{filled('amount2')} AND {v} <= 0"),
        ("r25_gt_zero", "gt_zero", {}, f"{v} <= 0"),
        ("r26_gte_zero", "gte_zero", {}, f"{v} < 0"),
        ("r27_equals_diff", "equals_diff", {"field2": "amount2", "field3": "amount3"}, f"abs({v} - ({v2} - {v3})) > 0.01"),
        ("r28_opposite_sign", "opposite_sign_or_zero", {"field2": "amount2"}, f"(({v2} > 0 AND {v} > 0) OR ({v2} < 0 AND {v} < 0))"),
        ("r29_range", "range_exclusive_min", {"low": 0.0, "high": 100.0}, f"NOT ({v} > 0 AND {v} <= 100)"),
    ):
        check_query(name, (lambda name=name, op=op, kw=kw: C.plausibility(name[:3], op, "amount", **kw), f"{name[:3]} amount WARNING", where))
    ref = lambda: F.lit("2024-01-31").cast("date")
    check_query("r30_reference_date", (lambda: C.date_order("r30a", "day", "lte", ref()), "r30a day WARNING", f"{date('day')} > DATE '2024-01-31'"), (lambda: C.date_order("r30b", "day", "gte", ref()), "r30b day WARNING", f"{date('day')} < DATE '2024-01-31'"))
    check_query("r31_date_order", (lambda: C.date_order("r31a", "day", "lte", "day2"), "r31a day WARNING", f"{date('day')} > {date('day2')}"), (lambda: C.date_order("r31b", "day", "gte", "day2"), "r31b day WARNING", f"{date('day')} < {date('day2')}"))
    forms = (("ISIN", "isin", "[A-Z]{2}[A-Z0-9]{10}"), ("LEI", "lei", "[0-9A-Z]{20}"), ("ISO3166_ALPHA2", "country", "[A-Z]{2}"), ("BIC", "bic", "[A-Z]{4}[A-Z]{2}[A-Z0-9]{2}([A-Z0-9]{3})?"))
    check_query("r32_identifier_format", *[(lambda k=k, f=f: C.identifier_format(f"r32{k}", f, k), f"r32{k} {f} WARNING", f"{filled(f)} AND NOT {full(f, p)}") for k, f, p in forms])

    n = decimal
    check_query("b01_structural_subordination_rank", (lambda: B.structural_subordination_rank("flag", "amount"), "structural_subordination_rank amount WARNING", f"{strip('flag')} = '1' AND {miss('amount')}"))
    check_query("b02_own_funds_rank", (lambda: B.own_funds_rank_check("flag", "amount"), "own_funds_rank_check amount WARNING", f"{strip('flag')} IN ('T1', 'T2', 'AT1') AND {miss('amount')}"))
    check_query("b03_zero_coupon_accruals", (lambda: B.zero_coupon_accruals("amount2", "amount"), "zero_coupon_accruals amount WARNING", f"{n('amount2')} = 0 AND {n('amount')} <> 0"))
    check_query("b04_non_structured_fields_empty", *[(lambda f=f: B.non_structured_fields_empty("flag", [f])[0], f"non_structured_fields_empty {f} WARNING", f"{strip('flag')} = '0' AND {filled(f)}") for f in ("amount", "day")])
    check_query("b05_unsecured_no_collateral", (lambda: B.unsecured_no_collateral("flag", "amount3"), "unsecured_no_collateral amount3 WARNING", f"{strip('flag')} = '0' AND {filled('amount3')}"))
    check_query("b06_securities_count", (lambda: B.securities_count_consistency("amount", "amount2"), "securities_count_consistency amount2 WARNING", f"{n('amount')} > 0 AND {n('amount2')} = 0"))
    check_query("b07_ccp_cleared", (lambda: B.ccp_cleared_stay_na("flag", "isin"), "ccp_cleared_stay_na isin WARNING", f"{strip('flag')} = '1' AND {filled('isin')}"))
    check_query("b08_carrying_amount", (lambda: B.carrying_amount_plausibility("amount", "amount3"), "carrying_amount_plausibility amount WARNING", f"{n('amount3')} > 0 AND abs({n('amount')}) > 1.5 * {n('amount3')}"))
    check_query("b09_exchange_rate_positive", (lambda: B.eur_exchange_rate_positive("amount"), "eur_exchange_rate_positive amount WARNING", f"{n('amount')} <= 0"))
    check_query("b10_eur_rate_one", (lambda: B.eur_currency_rate_one("currency", "amount"), "eur_currency_rate_one amount WARNING", f"upper({strip('currency')}) = 'EUR' AND abs({n('amount')} - 1) > 0.0001"))
    check_query("x08_rank", (lambda: X.rank_check("x8", "amount"), "x8 amount ERROR", f"{filled('amount')} AND ({g} IS NULL OR {g} <= -1)"))
    extra = f"(CASE WHEN {miss('part_b')} THEN 0.0 ELSE {b} END)"
    plain = f"(CASE WHEN {miss('product')} THEN '' ELSE {strip('product')} END) IN {listed(X.PLAIN_PRODUCTS)}"
    check_query("x09_derived_amount", (lambda: X.derived_amount("x9", "result", "part_a", "part_b", "product"), "x9 result ERROR", f"{filled('result')} AND {plain} AND abs({r} - ({a} + {extra})) > 1.0"))
    check_query("x10_category_needs_field", (lambda: X.category_needs_field("x10", "category", "HIGH", "amount", list(("amount", "category"))), "x10 category ERROR", f"category LIKE '%HIGH%' AND {miss('amount')}"))
    pairs = (lambda: C.mandatory("m1", "amount"), "m1 amount ERROR", miss("amount"), "''"), (lambda: C.codelist("m2", "category", PRIORITIES), "m2 category ERROR", ORACLE_WHERE["category"](filled, allowed)), (lambda: C.plausibility("m3", "range_exclusive_min", "amount", low=0.0, high=100.0), "m3 amount WARNING", f"NOT ({v} > 0 AND {v} <= 100)")
    check_query("a13_fused_run", *pairs)


ORACLE_WHERE = {"category": lambda filled, allowed: f"{filled('category')} AND {strip('category')} NOT IN {allowed}"}

build()
