"""Queries of runs that a rule pack drives: one pack over four tables, without and with its country profile."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabguard.functions import predicates as P
from tabguard.operators import checks as C
from tabguard.plans.pack import run_pack
from tabguard.queries.views import ORDERS_SQL, date, decimal, dirty_orders, grouped, listed, miss, num, strip, table
from tabguard.sources import catalog
from tabguard.sources.scratch import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: what the view's columns are called in the delivery
CODES = {"amount": "c0080", "amount2": "c0090", "amount3": "c0100", "category": "c0140"}


def delivery(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    orders = dirty_orders(spark, d).withColumnsRenamed(CODES).withColumn("row", F.col("id").cast("long")).withColumn("cust", F.col("cust").cast("string"))
    customers = table(spark, d, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").cast("long").alias("row"), F.col("c_custkey").cast("string").alias("c0010"), F.col("c_mktsegment").alias("c0020"))
    return {"B02.00_TypeA": orders.where("id % 2 = 0"), "B02.00_TypeB": orders.where("id % 2 = 1").drop("lei"), "B01.00": customers, "B99.00": orders.select("row", F.col("day").alias("c0070"))}


def _rule(rule_id: str, level: str, kind: str, code: str = "", **more) -> dict:
    return {"rule_id": rule_id, "rule_level": level, "rule_type": kind, "template": "B02.00", "field_code": code} | more


_FULL = lambda f, p: f"regexp_full_match({f}, '{p}')"
_FILLED = lambda f: f"NOT {miss(f)}"
_SAME_TABLE = "id % 2"
_FIRST_DAY = f"(SELECT CASE WHEN NOT {miss('day')} THEN substr(day, 1, 10) END AS day FROM {ORDERS_SQL} f ORDER BY id LIMIT 1)"
_REFERENCE = f"(SELECT {date('day')} FROM {_FIRST_DAY} g)"
_AMOUNT = grouped("amount")
_NUMERIC = num("replace(replace(amount, ' ', ''), ',', '')")
_TOTALS = "(SELECT sum(CAST(part_a AS DOUBLE)) FROM {0} s WHERE s.id % 2 = {1})"
_PARENT = "(SELECT sum(CAST(c_custkey AS DOUBLE)) FROM customer WHERE c_custkey % 3 <> 0)"
_BESIDE = "(CASE WHEN EXISTS (SELECT 1 FROM customer WHERE c_custkey = t.id AND c_custkey % 3 <> 0) THEN (SELECT max(c_mktsegment) FROM customer WHERE c_custkey = t.id) ELSE (SELECT min_by(c_mktsegment, c_custkey) FROM customer WHERE c_custkey % 3 <> 0) END)"
_CODES = "(SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderpriority < '{0}')"
_ALWAYS = listed(C.ALWAYS_ALLOWED)
_LIST = f"{_FILLED('category')} AND {strip('category')} NOT IN {_ALWAYS} AND {strip('category')} NOT IN {_CODES}"

#: a rule, and of what it finds: severity, field, SQL condition over the view, SQL of the value
RULES: list[tuple[dict, tuple[str, str, str, str] | None]] = [
    (_rule("m1", "L1", "MANDATORY_FIELD", "0080"), ("ERROR", "0080", miss("amount"), "''")),
    (_rule("m2", "L1", "MANDATORY_FIELD", "day", condition=[{"field": "flag", "operator": "eq", "value": "1"}, {"field": "140", "operator": "in", "values": ["1-URGENT", "2-HIGH"]}]), ("ERROR", "day", f"flag = '1' AND lower({strip('category')}) IN ('1-urgent', '2-high') AND {miss('day')}", "''")),
    (_rule("m4", "L1", "MANDATORY_FIELD", "c0100", condition=[{"field": "B01.00.c0020", "operator": "eq", "value": "building"}]), ("ERROR", "c0100", f"lower({_BESIDE}) = 'building' AND {miss('amount3')}", "''")),
    (_rule("cl1", "CL", "CODELIST_CHECK", "c0140", codelist="priority"), ("ERROR", "c0140", _LIST, strip("category"))),
    (_rule("cl2", "CL", "CODELIST_CHECK", "flag", codelist_values=["0", "1"]), ("ERROR", "flag", f"{strip('flag')} NOT IN ('0', '1')", strip("flag"))),
    (_rule("cl3", "CL", "CODELIST_CHECK", "currency"), ("ERROR", "currency", f"{_FILLED('currency')} AND {strip('currency')} NOT IN ('EUR', 'XYZ')", strip("currency"))),
    (_rule("cl4", "CL", "CODELIST_CHECK", "country"), None),
    (_rule("dq1", "DQ", "VALUE_PLAUSIBILITY", field="c0080", operator="lte", field2="c0090"), ("WARNING", "c0080", f"{decimal('amount')} > {decimal('amount2')}", "amount")),
    (_rule("dq2", "DQ", "VALUE_PLAUSIBILITY", field="80", operator="range_exclusive_min", range_max=100.0, severity="ERROR"), ("ERROR", "80", f"NOT ({decimal('amount')} > 0 AND {decimal('amount')} <= 100)", "amount")),
    (_rule("dq3", "DQ", "CONDITIONAL_MANDATORY", condition_field="flag", operator="eq", condition_value="1", target_field="c0080"), ("WARNING", "c0080", f"{strip('flag')} = '1' AND {miss('amount')}", "'<empty>'")),
    (_rule("dq4", "DQ", "DATE_CONSISTENCY", field="day", operator="lte_refdate"), ("WARNING", "day", f"{date('day')} > {_REFERENCE}", "day")),
    (_rule("dq5", "DQ", "DATE_CONSISTENCY", field="day", operator="gte_field", field2="day2"), ("WARNING", "day", f"{date('day')} < {date('day2')}", "day")),
    (_rule("dq6", "DQ", "FORMAT_CHECK", field="bic", format_type="BIC"), ("WARNING", "bic", f"{_FILLED('bic')} AND NOT {_FULL('bic', '[A-Z]{4}[A-Z]{2}[A-Z0-9]{2}([A-Z0-9]{3})?')}", "bic")),
    (_rule("dq7", "DQ", "UNIQUENESS_CHECK", key_fields=["cust", "flag", "c9998"]), ("WARNING", "cust,flag,c9998", f"EXISTS (SELECT 1 FROM {ORDERS_SQL} u WHERE u.id < t.id AND u.id % 2 = t.id % 2 AND u.cust = t.cust AND u.flag = t.flag)", "CAST(cust AS STRING) || ', ' || flag")),
    (_rule("dq8", "DQ", "BUSINESS_LOGIC", business_rule="eur_currency_rate_one", field="currency", field2="c0080"), ("WARNING", "c0080", f"upper({strip('currency')}) = 'EUR' AND abs({decimal('amount')} - 1) > 0.0001", "amount")),
    (_rule("dq9", "DQ", "BUSINESS_LOGIC", business_rule="lei_name_consistency", key_field="cust", value_field="c0140"), ("WARNING", "c0140", f"{_FILLED('category')} AND {strip('category')} <> (SELECT min_by({strip('u.category')}, u.id) FROM {ORDERS_SQL} u WHERE u.cust = t.cust AND u.id % 2 = t.id % 2 AND NOT {miss('u.category')})", strip("category"))),
    (_rule("dq10", "DQ", "CROSS_TEMPLATE_CONSISTENCY", field="cust", ref_template="B01.00", ref_field="10"), ("WARNING", "cust", "cust % 3 = 0", "CAST(cust AS STRING)")),
    (_rule("dq11", "DQ", "CROSS_TEMPLATE_CONSISTENCY", field="cust", ref_template="B07.00", ref_field="10"), None),
    (_rule("l2a", "L2", "CONSISTENCY_CHECK", "isin", operator="isin", type_field="idtype"), ("ERROR", "isin", f"{_FILLED('isin')} AND NOT {_FULL('isin', '[A-Z]{2}[A-Z0-9]{9}[0-9]')} AND upper(idtype) LIKE '%ISIN%'", "isin")),
    (_rule("l2b", "L2", "CONSISTENCY_CHECK", "0080", operator="integer", severity="ERROR"), ("WARNING", "0080", f"{_FILLED('amount')} AND NOT coalesce(isfinite({_AMOUNT}), false)", "amount")),
    (_rule("l2c", "L2", "CONSISTENCY_CHECK", "result", operator="sum_formula", terms=[{"sign": 1, "field": "part_a"}, {"sign": 1, "field": "part_b"}]), ("WARNING", "result", f"{_FILLED('result')} AND {_FILLED('part_a')} AND {_FILLED('part_b')} AND abs({grouped('result')} - ({grouped('part_a')} + {grouped('part_b')})) > 1.0", f"format('{{:,.2f}}', {grouped('result')}) || ' (expected: ' || format('{{:,.2f}}', {grouped('part_a')} + {grouped('part_b')}) || ')'")),
    (_rule("l2d", "L2", "CONSISTENCY_CHECK", "currency", operator="currency"), ("ERROR", "currency", f"{_FILLED('currency')} AND NOT (upper(currency) IN {listed(P.CURRENCIES)})", "upper(currency)")),
    (_rule("l2e", "L2", "CONSISTENCY_CHECK", "0080", operator="whole_from_one"), ("ERROR", "0080", f"{_FILLED('amount')} AND ({_AMOUNT} IS NULL OR {_AMOUNT} < 1 OR {_AMOUNT} <> floor({_AMOUNT}))", "amount")),
    (_rule("dpm1", "DPM", "DATATYPE_CHECK", "0080", operator="numeric", message="no number", dpm_reference="ref"), ("ERROR", "0080", f"{_FILLED('amount')} AND {_NUMERIC} IS NULL", "amount")),
    (_rule("x1", "CROSS", "CROSS_CHECK", "0080", operator="rank"), ("WARNING", "0080", f"{_FILLED('amount')} AND ({_AMOUNT} IS NULL OR {_AMOUNT} <= -1)", "amount")),
    (_rule("off", "L1", "MANDATORY_FIELD", "0080", enabled=False), None),
    (_rule("what", "L1", "NO_SUCH_KIND", "0080"), None),
    (_rule("none", "L2", "CONSISTENCY_CHECK", "c9997", operator="not_reported"), None),
]
#: rules of the country profile alone
COUNTRY: list[tuple[dict, tuple[str, str, str, str] | None]] = [
    (_rule("de1", "DPM", "FORMAT_CHECK", "country", operator="country", de_only=True), ("ERROR", "country", f"{_FILLED('country')} AND NOT (upper(country) IN {listed(P.COUNTRIES)} OR {_FULL('upper(country)', '[A-Z]{2}-[A-Z0-9]{1,3}')})", "country")),
]
#: rules whose findings are about tables: x2 of both variants, m3 of the one that lacks the column
WHOLE = [_rule("m3", "L1", "MANDATORY_FIELD", "lei", condition=[{"field": "flag", "operator": "eq", "value": "never"}]), _rule("x2", "CROSS", "CROSS_CHECK", field="part_a", operator="totals", ref_template="B01.00", ref_field="c0010")]
COLUMNS = ("rule_id", "rule_level", "rule_type", "template", "severity", "row", "field_code", "value")


def pack(spark: SparkSession, d: str) -> DataFrame:
    """The pack as a JSON file, its code lists taken from the tables, read back."""
    rules = [r for r, _ in (*RULES, *COUNTRY)] + WHOLE
    lists = table(spark, d, "orders").select("o_orderpriority").distinct().agg(*[F.array_sort(F.collect_list(F.when(F.col("o_orderpriority") < high, F.col("o_orderpriority")))).alias(n) for n, high in (("priority", "4"), ("DE_priority", "3"))])
    made = lists.select(
        F.struct(F.lit("1.0").alias("version")).alias("metadata"), F.from_json(F.lit(json.dumps(rules)), f"array<{catalog.RULES}>").alias("rules"),
        F.create_map(F.lit("priority"), "priority", F.lit("DE_priority"), "DE_priority", F.lit("money"), F.array(F.lit("EUR"), F.lit("XYZ"))).alias("codelists"),
        F.create_map(F.lit("B02.00;currency"), F.lit("money")).alias("field_codelist_map"),
    )
    path = scratch_path(spark, "rule-pack")
    made.select(F.to_json(F.struct("*"))).write.text(path)
    return catalog.read_pack(spark, path)


def _run(country: bool) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        read = pack(spark, d)
        rules, lists = catalog.overlaid(catalog.rules_of(read), catalog.codelists_of(read), country, ("priority",))
        return run_pack(spark, delivery(spark, d), rules, lists, catalog.field_lists_of(read)).select(*COLUMNS)

    return run


def _sql(country: bool) -> str:
    template = f"CASE WHEN {_SAME_TABLE} = 0 THEN 'B02.00_TypeA' ELSE 'B02.00_TypeB' END"
    fixed = lambda r, severity, field: f"SELECT '{r['rule_id']}' AS rule_id, '{r['rule_level']}' AS rule_level, '{r['rule_type']}' AS rule_type, {{}} AS template, '{severity}' AS severity, {{}} AS row, '{field}' AS field_code, {{}} AS value"
    parts = []
    for r, told in (*RULES, *COUNTRY) if country else RULES:
        if told:
            severity, field, where, value = told
            where = where.replace(_CODES, _CODES.format("3" if country else "4"))
            parts.append(fixed(r, severity, field).format(template, "CAST(id AS BIGINT)", f"substr(coalesce({value}, ''), 1, 200)") + f" FROM {ORDERS_SQL} AS t WHERE {where}")
    parts.append(fixed(WHOLE[0], "ERROR", "lei").format("'B02.00_TypeB'", "CAST(NULL AS BIGINT)", "''"))
    for k, name in enumerate(("B02.00_TypeA", "B02.00_TypeB")):
        a = _TOTALS.format(ORDERS_SQL, k)
        parts.append(fixed(WHOLE[1], "WARNING", "part_a").format(f"'{name}'", "CAST(NULL AS BIGINT)", f"format('{{:,.2f}}', {a}) || ' / ' || format('{{:,.2f}}', {_PARENT})").replace("{{", "{").replace("}}", "}") + f" WHERE abs({a} - {_PARENT}) > 1.0")
    return " UNION ALL ".join(parts)


QUERIES |= {"a13_rule_pack": _run(False), "a13_rule_pack_overlay": _run(True)}
ORACLE |= {"a13_rule_pack": _sql(False), "a13_rule_pack_overlay": _sql(True)}
