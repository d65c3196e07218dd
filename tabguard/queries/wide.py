"""Queries of the multi-row and cross-table checks, expression values and reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabguard.functions import expressions as E
from tabguard.operators import business as B
from tabguard.operators import checks as C
from tabguard.operators import cross as X
from tabguard.operators import membership as M
from tabguard.operators import report as R
from tabguard.plans.validation import assertion, first_row_only
from tabguard.queries.rows import PRIORITIES
from tabguard.queries.views import ORDERS_SQL, decimal, dirty_orders, grouped, miss, strip, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f

    return keep


# ---- keys, references, totals -------------------------------------------------

LINE = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate"


@query(
    "x01_repeated_keys",
    f"SELECT l_orderkey, l_linenumber, l_partkey, CAST(n AS INT) AS occurrence FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {LINE.split(', ', 2)[2]}) AS n FROM lineitem) WHERE n > 1",
)
def repeated_keys(spark, d):
    return X.repeated_keys(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber", "absent"], LINE.split(", ")[2:]).select("l_orderkey", "l_linenumber", "l_partkey", "occurrence")


@query(
    "x02_totals_differ",
    "SELECT round(a, 2) AS total_a, round(b, 2) AS total_b FROM (SELECT sum(CAST(l_quantity AS DOUBLE)) AS a FROM lineitem) x, (SELECT sum(CAST(o_custkey AS DOUBLE)) AS b FROM orders) y WHERE abs(a - b) > 1.0",
)
def totals_differ(spark, d):
    a = table(spark, d, "lineitem").select(F.col("l_quantity").cast("string").alias("v"))
    b = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("v"))
    return X.totals_differ(a, "v", b, "v").select(F.round("total_a", 2).alias("total_a"), F.round("total_b", 2).alias("total_b"))


@query(
    "x03_conditional_totals_differ",
    "SELECT round(a, 2) AS total_a, round(b, 2) AS total_b FROM (SELECT sum(CAST(o_custkey AS DOUBLE)) AS a FROM orders) x, "
    "(SELECT sum(CAST(o_custkey AS DOUBLE)) AS b FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED')) y WHERE a > 0 AND b > 0 AND abs(a - b) > 0.05 * a",
)
def conditional_totals(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("v"), F.col("o_orderpriority").alias("cat"))
    return X.conditional_totals_differ(o, "v", o, "v", "cat", PRIORITIES).select(F.round("total_a", 2).alias("total_a"), F.round("total_b", 2).alias("total_b"))


@query("x04_unmatched_references", f"SELECT id, {strip('flag')} AS value FROM {ORDERS_SQL} t WHERE NOT {miss('flag')} AND {strip('flag')} NOT IN (SELECT CAST(c_nationkey AS STRING) FROM customer)")
def unmatched_references(spark, d):
    return X.unmatched_references(dirty_orders(spark, d), "flag", table(spark, d, "customer"), "c_nationkey", ["id"])


@query("x05_unmatched", "SELECT o_orderkey, CAST(o_orderkey AS STRING) AS value FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def unmatched(spark, d):
    return X.unmatched(table(spark, d, "orders"), "o_orderkey", table(spark, d, "lineitem"), "l_orderkey", ["o_orderkey"])


@query("x05_unmatched_by_bitmap", "SELECT o_orderkey, CAST(o_orderkey AS STRING) AS value FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'F')")
def unmatched_by_bitmap(spark, d):
    parents = table(spark, d, "lineitem").where("l_linestatus = 'F'")
    return X.unmatched(table(spark, d, "orders"), "o_orderkey", parents, "l_orderkey", ["o_orderkey"], filtered=True)


@query("x06_overlapping_by_bitmap", "SELECT o_orderkey, CAST(o_custkey AS STRING) AS value FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderkey % 5 = 0)")
def overlapping_by_bitmap(spark, d):
    orders = table(spark, d, "orders")
    return X.overlapping(orders.where("o_orderpriority = '1-URGENT' AND o_orderkey % 5 = 0"), orders, "o_custkey", ["o_orderkey"], filtered=True)


_TWICE = "SELECT '{0}' AS delivery, l_orderkey AS c0020, l_linenumber, l_partkey, CAST(l_orderkey AS STRING) AS value FROM lineitem b WHERE l_linestatus = 'F' AND EXISTS (SELECT 1 FROM lineitem a WHERE {1} AND a.l_orderkey = b.l_orderkey)"


@query("x06_overlapping", f"{_TWICE.format('both', chr(97) + '.l_linestatus = ' + repr('O'))} UNION ALL {_TWICE.format('plain', 'a.l_returnflag = ' + repr('R'))}")
def overlapping(spark, d):
    """A delivery with both submissions, and one with the plain table in place of the first."""
    line = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "c0020")
    b = {"B02.00_TypeB": line.where("l_linestatus = 'F'")}
    plain = line.where("l_returnflag = 'R'").withColumnRenamed("c0020", "0020")
    given = {"both": b | {"B02.00_TypeA": line.where("l_linestatus = 'O'"), "B02.00": line}, "plain": b | {"B02.00": plain}}
    found = [X.counted_twice(t, "B02.00", "c0020", ["c0020", "l_linenumber", "l_partkey"]).select(F.lit(k).alias("delivery"), "*") for k, t in given.items()]
    return found[0].unionByName(found[1])


@query("x07_needs_table", f"SELECT id, category AS value FROM {ORDERS_SQL} t WHERE category LIKE '%HIGH%'")
def needs_table(spark, d):
    orders = dirty_orders(spark, d)
    return X.needs_table({"B01.00": orders}, orders, "category", "HIGH", ["B04.00", "B05.00"], ["id"])


ALIGNED = f"""(SELECT t.*, n.n AS own, CASE WHEN trim(v.v) = '' THEN NULL ELSE v.v END AS other FROM
 (SELECT *, row_number() OVER (ORDER BY id) + 1 AS row FROM {ORDERS_SQL}) t LEFT JOIN
 (SELECT row_number() OVER (ORDER BY c_custkey) + 1 AS row, CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN ' ' ELSE c_mktsegment END AS v FROM customer) c USING (row)
 CROSS JOIN (SELECT CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN ' ' ELSE c_mktsegment END AS v FROM customer ORDER BY c_custkey LIMIT 1) f
 CROSS JOIN LATERAL (SELECT c.row AS n) n CROSS JOIN LATERAL (SELECT CASE WHEN c.row IS NULL THEN f.v ELSE c.v END AS v) v)"""


def _aligned(spark, d):
    from tabguard.sources.scratch import scratch_path
    from tabguard.sources.tables import with_row_numbers

    def filed(df, name):
        path = scratch_path(spark, name)
        df.write.parquet(path)
        return with_row_numbers(spark.read.schema(df.schema).parquet(path))

    orders = filed(dirty_orders(spark, d).orderBy("id"), "orders")
    side = table(spark, d, "customer").selectExpr("c_custkey", "CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN ' ' ELSE c_mktsegment END AS v").orderBy("c_custkey")
    return X.aligned(orders, filed(side, "customer"), "v")


@query("x11_aligned", f"SELECT id, CAST(row AS BIGINT) AS row, other FROM {ALIGNED} q")
def aligned(spark, d):
    return _aligned(spark, d).select("id", "row", "other")


@query("b11_first_value_conflicts", "SELECT p_partkey, p_name, p_brand AS value, first AS first_value FROM (SELECT *, first_value(p_brand) OVER (PARTITION BY p_name ORDER BY p_partkey) AS first FROM part) WHERE p_brand <> first")
def conflicts(spark, d):
    return B.first_value_conflicts(table(spark, d, "part"), "p_name", "p_brand", ["p_partkey"], ["p_partkey"])


_UNIQUE = {"u1": ("cust", "flag"), "u2": ("category", "day"), "u3": ("isin", "lei", "country")}
_DEPENDENT = {"d1": ("cust", "category"), "d2": ("isin", "country")}


def _first_seen_sql() -> str:
    own = lambda f: f"{strip(f'CAST({f} AS STRING)')}"
    whole = lambda fs: " AND ".join(f"NOT {miss(f'CAST({f} AS STRING)')}" for f in fs)
    parts = [f"SELECT '{r}' AS rule_id, id, CAST(NULL AS STRING) AS value, CAST(NULL AS STRING) AS first_value FROM (SELECT id, row_number() OVER (PARTITION BY {', '.join(map(own, fs))} ORDER BY id) AS n FROM {ORDERS_SQL} t WHERE {whole(fs)}) WHERE n > 1" for r, fs in _UNIQUE.items()]
    parts += [f"SELECT '{r}', id, v, f FROM (SELECT id, {own(v)} AS v, first_value({own(v)}) OVER (PARTITION BY {own(k)} ORDER BY id) AS f FROM {ORDERS_SQL} t WHERE {whole((k, v))}) WHERE v <> f" for r, (k, v) in _DEPENDENT.items()]
    return " UNION ALL ".join(parts)


@query("x01_keys_in_one_pass", _first_seen_sql())
def keys_in_one_pass(spark, d):
    """Three keys and two dependencies, found by one aggregate."""
    return X.first_seen(dirty_orders(spark, d), _UNIQUE, _DEPENDENT, ["id"], ["id"]).select("rule_id", "id", "value", "first_value")


@query("r04_dropdown", "SELECT o_orderkey AS id, trim(o_orderpriority) AS value FROM orders WHERE trim(o_orderpriority) NOT IN (SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderpriority < '4')")
def dropdown(spark, d):
    orders = table(spark, d, "orders")
    allowed = orders.where("o_orderpriority < '4'").select(F.col("o_orderpriority").alias("value"))
    return C.codelist_join(orders.select(F.col("o_orderkey").alias("id"), "o_orderpriority"), "o_orderpriority", allowed, ["id"])


# ---- expression values -----------------------------------------------------------


def _fold(x: str) -> str:
    return f"replace(lower({strip(x)}), 'ß', 'ss')"


def _same(a: str, b: str) -> str:
    return f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN {a} IS NULL AND {b} IS NULL WHEN {grouped(a)} IS NOT NULL AND {grouped(b)} IS NOT NULL THEN {grouped(a)} = {grouped(b)} ELSE {_fold(a)} = {_fold(b)} END"


def _cmp(a: str, b: str, op: str) -> str:
    return f"coalesce(CASE WHEN {grouped(a)} IS NOT NULL AND {grouped(b)} IS NOT NULL THEN {grouped(a)} {op} {grouped(b)} ELSE {a} {op} {b} END, false)"


A, B2, A3 = "amount", "amount2", "amount3"
_BLANK = f"({A} IS NULL OR {strip(A)} = '')"
_TRUE = f"coalesce({strip(A)} <> '', false)"
_TRUE3 = f"coalesce({strip(A3)} <> '', false)"
_BAD = f"({grouped(A)} IS NULL OR {grouped(A3)} IS NULL)"


def values(name: str, sql: str, make) -> None:
    QUERIES[name] = lambda s, d: dirty_orders(s, d).select("id", *[c.alias(n) for n, c in make(*[E.text(F.col(f)) for f in (A, B2, A3)]).items()])
    ORACLE[name] = f"SELECT id, {sql} FROM {ORDERS_SQL} t"


def pair(name: str, v: E.Val) -> dict:
    """A value where its evaluation succeeds, and whether it failed."""
    return {name: F.when(~v.err, v.value), f"{name}_err": v.err}


values("e01_equal", f"{_same(A, B2)} AS eq, NOT ({_same(A, B2)}) AS ne, {_same(A, 'day')} AS day_eq", lambda a, b, c: {"eq": E.eq(a, b).value, "ne": E.ne(a, b).value, "day_eq": E.eq(a, E.text(F.col("day"))).value})
values("e02_order", ", ".join(f"{_cmp(A, B2, o)} AS {n}" for n, o in (("lt", "<"), ("le", "<="), ("gt", ">"), ("ge", ">="))), lambda a, b, c: {n: f(a, b).value for n, f in (("lt", E.lt), ("le", E.le), ("gt", E.gt), ("ge", E.ge))})
_IN = f"(({_same(A, B2)}) OR ({_same(A, A3)}))"
values("e03_in", f"{A} IS NOT NULL AND {_IN} AS inside, {A} IS NOT NULL AND NOT {_IN} AS outside", lambda a, b, c: {"inside": E.is_in(a, [b, c]).value, "outside": E.not_in(a, [b, c]).value})
_LISTED = "(SELECT CASE l_orderkey % 4 WHEN 0 THEN ' ' || CAST(l_partkey AS STRING) || '.0' WHEN 1 THEN '2024-01-31' WHEN 2 THEN 'ABC ' ELSE CAST(l_quantity AS STRING) END AS v FROM lineitem)"
_INSIDE = f"(CASE WHEN {grouped(A)} IS NOT NULL THEN {grouped(A)} IN (SELECT {grouped('v')} FROM {_LISTED} q WHERE {grouped('v')} IS NOT NULL) ELSE {_fold(A)} IN (SELECT {_fold('v')} FROM {_LISTED} q WHERE {grouped('v')} IS NULL) END)"


@query("e03_in_table", f"SELECT id, {A} IS NOT NULL AND {_INSIDE} AS inside, {A} IS NOT NULL AND NOT {_INSIDE} AS outside FROM {ORDERS_SQL} t")
def in_table(spark, d):
    """Membership in as many values as there are order lines, of which some are numbers and some are not."""
    listed_values = table(spark, d, "lineitem").selectExpr("CASE l_orderkey % 4 WHEN 0 THEN ' ' || CAST(l_partkey AS STRING) || '.0' WHEN 1 THEN '2024-01-31' WHEN 2 THEN 'ABC ' ELSE CAST(l_quantity AS STRING) END AS v")
    return M.in_table(dirty_orders(spark, d), E.text(F.col(A)), listed_values, "v", "inside", "outside").select("id", "inside", "outside")


values("e04_add", f"CASE WHEN {grouped(A)} IS NOT NULL AND {grouped(A3)} IS NOT NULL THEN {grouped(A)} + {grouped(A3)} END AS total, CASE WHEN {_BAD} THEN coalesce({A}, '') || coalesce({A3}, '') END AS joined", lambda a, b, c: {"total": F.when(E.num(a).isNotNull() & E.num(c).isNotNull(), E.num(E.add(a, c))), "joined": F.when(E.num(a).isNull() | E.num(c).isNull(), E.add(a, c).value)})
values(
    "e05_arithmetic",
    ", ".join(f"CASE WHEN NOT {_BAD} THEN {grouped(A)} {o} {grouped(A3)} END AS {n}, {_BAD} AS {n}_err" for n, o in (("minus", "-"), ("times", "*")))
    + f", CASE WHEN NOT {_BAD} AND {grouped(A)} <> 0 THEN {grouped(A3)} / {grouped(A)} END AS ratio, ({_BAD} OR {grouped(A)} = 0) AS ratio_err, CASE WHEN {grouped(A)} IS NOT NULL THEN -{grouped(A)} END AS negative, {grouped(A)} IS NULL AS negative_err",
    lambda a, b, c: pair("minus", E.sub(a, c)) | pair("times", E.mul(a, c)) | pair("ratio", E.div(c, a)) | pair("negative", E.neg(a)),
)
values("e06_logic", f"{_TRUE} AND {_TRUE3} AS both, {_TRUE} OR {_TRUE3} AS either, NOT {_TRUE} AS negated", lambda a, b, c: {"both": E.and_(a, c).value, "either": E.or_(a, c).value, "negated": E.not_(a).value})
values("e07_null", f"{_BLANK} AS empty, NOT {_BLANK} AS filled, NOT {_BLANK} AS reported", lambda a, b, c: {"empty": E.is_null(a).value, "filled": E.is_not_null(a).value, "reported": E.is_reported(a).value})
values(
    "e08_abs_min_max",
    f"CASE WHEN {grouped(A)} IS NOT NULL THEN abs({grouped(A)}) END AS size, {grouped(A)} IS NULL AS size_err, CASE WHEN NOT {_BAD} THEN least({grouped(A)}, {grouped(A3)}) END AS low, {_BAD} AS low_err, CASE WHEN NOT {_BAD} THEN greatest({grouped(A)}, {grouped(A3)}) END AS high, {_BAD} AS high_err",
    lambda a, b, c: pair("size", E.abs_(a)) | pair("low", E.least(a, c)) | pair("high", E.greatest(a, c)),
)
values("e09_text", f"CAST(length(coalesce({A}, '')) AS INT) AS n, lower(coalesce({A}, '')) AS small, upper(coalesce({A}, '')) AS large", lambda a, b, c: {"n": E.length(a).value, "small": E.lower(a).value, "large": E.upper(a).value})

_FOUND = "id, 'asserted' AS rule_id, substr(coalesce(amount, ''), 1, 200) AS value"
_CLAIM = f"{grouped(A)} IS NOT NULL AND {grouped(A3)} IS NOT NULL AND NOT ({grouped(A)} - {grouped(A3)} > 0)"


def _claim():
    a, c = E.text(F.col(A)), E.text(F.col(A3))
    return E.gt(E.sub(a, c), E.Val(F.lit(0.0), F.lit(False), "number"))


def _asserted(df, condition, claim):
    return C.fuse(df, [assertion("asserted", A, condition, claim)], keys=["id"]).select("id", "rule_id", "value")


@query("e10_row_assertion", f"SELECT {_FOUND} FROM {ORDERS_SQL} t WHERE coalesce({_same('flag', chr(39) + '1' + chr(39))}, false) AND {_CLAIM}")
def row_assertion(spark, d):
    return _asserted(dirty_orders(spark, d), E.eq(E.text(F.col("flag")), E.text(F.lit("1"))), _claim())


@query("e11_table_assertion", f"SELECT {_FOUND} FROM (SELECT * FROM {ORDERS_SQL} s WHERE amount IS NOT NULL ORDER BY id LIMIT 1) t WHERE NOT ({_same(A, chr(39) + 'never' + chr(39))})")
def table_assertion(spark, d):
    first = first_row_only(dirty_orders(spark, d).where("amount IS NOT NULL"), ["id"])
    return _asserted(first, None, E.eq(E.text(F.col(A)), E.text(F.lit("never"))))


@query("r02_cross_table_gate", f"SELECT id, 'gated' AS rule_id, '' AS value FROM {ALIGNED} q WHERE other IS NOT NULL AND {miss(A)}")
def cross_table_gate(spark, d):
    check = C.gated(C.mandatory("gated", A), E.is_not_null(E.field("other")))
    return C.fuse(_aligned(spark, d), [check], keys=["id"]).select("id", "rule_id", "value")


@query("e10_unknown_column", f"SELECT {_FOUND} FROM {ORDERS_SQL} t WHERE flag = '1' AND {_BLANK}")
def unknown_column(spark, d):
    """A condition that needs an unknown column is decided by what stands before it, or the row is passed over."""
    said = lambda x: E.text(F.lit(x))
    unknown = E.eq(E.field("unheard of"), said("1"))
    claim = E.is_not_null(E.field(A))
    checks = [assertion("asserted", A, E.or_(E.eq(E.field("flag"), said("1")), unknown), claim), assertion("never", A, unknown, claim), assertion("nor", "unheard of", None, unknown)]
    return C.fuse(dirty_orders(spark, d), checks, keys=["id"]).select("id", "rule_id", "value")


@query("e12_cross_assertion", f"SELECT {_FOUND} FROM {ALIGNED} q WHERE other IS NOT NULL AND NOT (amount IS NOT NULL AND {strip(A)} <> '')")
def cross_assertion(spark, d):
    return _asserted(_aligned(spark, d), E.is_not_null(E.text(F.col("other"))), E.is_not_null(E.text(F.col(A))))


@query("e13_mandatory_assertion", f"SELECT {_FOUND} FROM {ORDERS_SQL} t WHERE flag = '0' AND {_BLANK}")
def mandatory_assertion(spark, d):
    return _asserted(dirty_orders(spark, d), E.eq(E.text(F.col("flag")), E.text(F.lit("0"))), E.is_not_null(E.text(F.col(A))))


# ---- reports over the findings of a run ---------------------------------------------


def run_findings(spark: SparkSession, d: str, allowed=PRIORITIES, high: int = 100) -> DataFrame:
    """A fused run over all orders: three rules of three levels and both severities."""
    checks = [
        C.mandatory("m1", "amount", rule_level="L1", template="B01.00"),
        C.codelist("m2", "category", allowed, rule_level="CL", template="B02.00", explanation=""),
        C.plausibility("m3", "range_exclusive_min", "amount", low=0.0, high=float(high), rule_level="DQ", template="B02.00"),
    ]
    return C.fuse(dirty_orders(spark, d), checks, row="id")


def _run_sql(values=PRIORITIES, high: int = 100) -> str:
    allowed = ", ".join(f"'{v}'" for v in sorted({*values, *C.ALWAYS_ALLOWED}))
    v = decimal(A)
    rules = [
        ("m1", "L1", "MANDATORY", "B01.00", "ERROR", "amount", "''", miss(A)),
        ("m2", "CL", "CODELIST_CHECK", "B02.00", "ERROR", "category", "category", f"NOT {miss('category')} AND {strip('category')} NOT IN ({allowed})"),
        ("m3", "DQ", "PLAUSIBILITY", "B02.00", "WARNING", "amount", "amount", f"NOT ({v} > 0 AND {v} <= {high})"),
    ]
    return "(" + " UNION ALL ".join(f"SELECT '{i}' AS rule_id, '{lv}' AS rule_level, '{ty}' AS rule_type, '{te}' AS template, '{se}' AS severity, CAST(id AS BIGINT) AS row, '{fi}' AS field_code, substr(coalesce({va}, ''), 1, 200) AS value FROM {ORDERS_SQL} t WHERE {wh}" for i, lv, ty, te, se, fi, va, wh in rules) + ")"


RUN = _run_sql()
#: run_id("in", "2024-01-31T08:00:00Z")
RUN_ID = "03945168-f205-5565-b14d-bf36366a5841"
_ORDER = "severity <> 'ERROR', template, coalesce(row, 0), rule_id, field_code, value"

query("a01_totals", f"SELECT count(*) AS total, count(*) FILTER (severity = 'ERROR') AS errors, count(*) FILTER (severity = 'WARNING') AS warnings FROM {RUN} r")(lambda s, d: R.totals(run_findings(s, d)))
query("a02_counts_by", f"SELECT 'template' AS dimension, template AS value, count(*) AS n FROM {RUN} r GROUP BY ALL UNION ALL SELECT 'rule_type', rule_type, count(*) FROM {RUN} r GROUP BY ALL UNION ALL SELECT 'rule_level', rule_level, count(*) FROM {RUN} r GROUP BY ALL")(lambda s, d: R.counts_by(run_findings(s, d)))
query("a03_severity_matrix", f"SELECT template AS value, count(*) FILTER (severity = 'ERROR') AS errors, count(*) FILTER (severity = 'WARNING') AS warnings FROM {RUN} r GROUP BY ALL")(lambda s, d: R.severity_matrix(run_findings(s, d), "template"))
query("a04_severity_histogram", f"SELECT severity, count(*) AS n FROM {RUN} r GROUP BY ALL")(lambda s, d: R.severity_histogram(run_findings(s, d)))
query("a06_top_findings", f"SELECT severity, template, row, rule_id, field_code, value FROM {RUN} r ORDER BY {_ORDER} LIMIT 10")(lambda s, d: R.top_findings(run_findings(s, d)).select("severity", "template", "row", "rule_id", "field_code", "value"))
query("a07_status", f"SELECT CASE WHEN e > 0 THEN 'errors' WHEN t > 0 THEN 'warnings' ELSE 'clean' END AS status, e > 0 AS failed FROM (SELECT count(*) AS t, count(*) FILTER (severity = 'ERROR') AS e FROM {RUN} r)")(lambda s, d: R.status(run_findings(s, d)))
query("a08_labels", f"SELECT rule_level, CASE rule_level WHEN 'L1' THEN 'L1 - Completeness' WHEN 'CL' THEN 'CL - Code lists' WHEN 'DQ' THEN 'DQ - Data quality' ELSE rule_level END AS label, count(*) AS n FROM {RUN} r GROUP BY ALL")(
    lambda s, d: R.labelled(run_findings(s, d), "rule_level").groupBy("rule_level", "label").agg(F.count("*").alias("n"))
)
query("a09_coverage", f"SELECT p.rule_id, count(r.rule_id) AS n FROM (SELECT DISTINCT 'm' || CAST(o_custkey % 6 AS STRING) AS rule_id FROM orders) p LEFT JOIN {RUN} r USING (rule_id) GROUP BY ALL")(
    lambda s, d: R.coverage(table(s, d, "orders").selectExpr("'m' || CAST(o_custkey % 6 AS STRING) AS rule_id").distinct(), run_findings(s, d))
)


def digest_sql(text: str) -> str:
    half = lambda at: f"CAST(coalesce(sum(CAST(CAST('0x' || substr(sha256({text}), {at}, 16) AS UBIGINT) AS HUGEINT)), 0) AS VARCHAR)"
    return f"{half(1)} || ':' || {half(17)}"


_SIGNED = ("id", "amount", "amount2", "day", "category", "bic")
_ROW = " || ".join(f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in _SIGNED)
query("a11_fingerprint", f"SELECT count(*) AS n, {digest_sql(_ROW)} AS digest FROM {ORDERS_SQL} t")(lambda s, d: R.fingerprint(dirty_orders(s, d).select(*_SIGNED)))


@query("a05_numbered", f"SELECT row_number() OVER (ORDER BY {_ORDER}) AS seq, rule_id, row, value FROM {RUN} r")
def numbered(spark, d):
    return R.numbered(run_findings(spark, d)).select(F.col("seq").cast("bigint").alias("seq"), "rule_id", "row", "value")


@query("a10_manifest", f"SELECT '{RUN_ID}' AS run_id, '2024-01-31T08:00:00Z' AS started_at, '2024-01-31T08:05:00Z' AS finished_at, 'in' AS path, true AS de_annex, count(*) AS n, count(*) FILTER (severity = 'ERROR') AS errors, count(*) FILTER (severity = 'WARNING') AS warnings, 'B01.00,B02.00' AS templates FROM {RUN} r")
def run_manifest(spark, d):
    m = R.manifest(run_findings(spark, d), ["B02.00", "B01.00"], "1.0", 3, "in", "csv_dir", "0:0", "2024-01-31T08:00:00Z", "2024-01-31T08:05:00Z", True)
    return m.select("run_id", "started_at", "finished_at", F.col("input.path").alias("path"), F.col("catalog.de_annex").alias("de_annex"), F.col("issues.count").alias("n"), F.col("issues.by_severity")["ERROR"].alias("errors"), F.col("issues.by_severity")["WARNING"].alias("warnings"), F.array_join("templates_loaded", ",").alias("templates"))


_KEYS = "rule_id, template, row, field_code, severity"


LATER = _run_sql(PRIORITIES[:2], 50)


@query("a12_issue_diff", f"SELECT {_KEYS}, 'expected' AS side FROM (SELECT {_KEYS} FROM {RUN} a EXCEPT ALL SELECT {_KEYS} FROM {LATER} b) UNION ALL SELECT {_KEYS}, 'actual' FROM (SELECT {_KEYS} FROM {LATER} b EXCEPT ALL SELECT {_KEYS} FROM {RUN} a)")
def issue_diff(spark, d):
    """A run against one with a shorter code list and a lower limit."""
    return R.issue_diff(run_findings(spark, d), run_findings(spark, d, PRIORITIES[:2], 50))
