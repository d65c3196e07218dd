"""Rule packs, runs that are committed, and what many checks, keys and values take."""

import json
import re

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tabguard.functions import expressions as E
from tabguard.functions.predicates import DATE_FORMATS, is_finite, is_integer_text, is_missing, parse_date, stripped
from tabguard.operators import checks as C
from tabguard.operators import cross as X
from tabguard.operators import membership as M
from tabguard.operators import report
from tabguard.plans.pack import run_pack
from tabguard.sources import catalog, sinks, tables

RULE = {"template": "B02.00", "rule_level": "CROSS", "rule_type": "CROSS_CHECK"}


def run(spark, tmp_path, given, rules, codelists=None, country=False, **how):
    path = tmp_path / f"pack-{len(list(tmp_path.iterdir()))}.json"
    path.write_text(json.dumps({"metadata": {"version": "1"}, "rules": rules, "codelists": codelists or {"none": []}, "field_codelist_map": {"B02.00;c0140": "kinds"}}))
    pack = catalog.read_pack(spark, str(path))
    own, lists = catalog.overlaid(catalog.rules_of(pack), catalog.codelists_of(pack), country, ("kinds",))
    return run_pack(spark, given, own, lists, catalog.field_lists_of(pack), **how)


def keys(found):
    return sorted(tuple(r) for r in found.select("rule_id", "template", F.coalesce("row", F.lit(0)), "field_code", "severity", "value").collect())


@pytest.fixture(scope="module")
def given(spark):
    liabilities = [
        (2, "a", "Deposits", "ISIN", "10", "4", "Vanilla"),
        (3, "a", "deposits", "CUSIP", "-1", "x", "Structured"),
        (4, "b", None, "ISIN", "0", "1e999", None),
        (5, "c", "Bonds", None, "7", "7", "Structured"),
    ]
    b = spark.createDataFrame(liabilities, "row long, c0010 string, c0140 string, c0040 string, c0080 string, c0170 string, c0250 string")
    a = spark.createDataFrame([(2, "a", "10"), (3, "z", "1")], "row long, c0010 string, c0020 string")
    return {"B02.00_TypeA": b, "B02.00_TypeB": a.select("row", "c0010"), "B01.00": a}


def test_families(spark, tmp_path, given):
    rules = [
        {**RULE, "rule_id": "twice", "operator": "counted_twice", "field": "10", "template": "B02.00_TypeB", "ref_template": "B02.00_TypeA"},
        {**RULE, "rule_id": "needs", "operator": "needs_table", "field": "c0250", "contains": "Structured", "tables": ["B04.00"], "template": "B02.00_TypeA"},
        {**RULE, "rule_id": "needs not", "operator": "needs_table", "field": "c0250", "contains": "Structured", "tables": ["B01.00"], "template": "B02.00_TypeA"},
        {**RULE, "rule_id": "category", "operator": "category_needs_field", "field": "c0250", "contains": "Structured", "field2": "c5010", "template": "B02.00_TypeA"},
        {**RULE, "rule_id": "rank", "operator": "rank", "field": "c0170", "template": "B02.00_TypeA", "severity": "ERROR"},
        {**RULE, "rule_id": "reference", "operator": "reference", "field": "0010", "ref_template": "B01.00", "ref_field": "10", "template": "B02.00_TypeA"},
        {**RULE, "rule_id": "total", "operator": "totals", "field": "c0080", "ref_template": "B01.00", "ref_field": "20", "template": "B02.00_TypeA"},
        {"rule_id": "none said", "rule_level": "L2", "rule_type": "CONSISTENCY_CHECK", "operator": "not_reported", "field_code": "c0250", "template": "B02.00"},
        {"rule_id": "list", "rule_level": "CL", "rule_type": "CODELIST_CHECK", "field_code": "c0140", "template": "B02.00"},
        {"rule_id": "country", "rule_level": "CL", "rule_type": "CODELIST_CHECK", "field_code": "c0140", "template": "B02.00", "codelist": "kinds", "de_only": True},
        {"rule_id": "if type", "rule_level": "L1", "rule_type": "MANDATORY_FIELD", "field_code": "c0250", "template": "B02.00_TypeA", "condition": [{"field": "40", "operator": "eq", "value": "isin"}, {"field": "c0080", "operator": "ge", "value": "0"}]},
        {"rule_id": "absent", "rule_level": "L1", "rule_type": "MANDATORY_FIELD", "field_code": "c0777", "template": "B02.00_TypeB"},
        {"rule_id": "nowhere", "rule_level": "L1", "rule_type": "MANDATORY_FIELD", "field_code": "c0777", "template": "B09.00"},
    ]
    lists = {"kinds": ["Deposits"], "DE_kinds": ["Bonds", "Deposits"]}
    a, b = "B02.00_TypeA", "B02.00_TypeB"
    want = [
        ("twice", b, 2, "10", "WARNING", "a"), ("needs", a, 3, "c0250", "WARNING", "Structured"), ("needs", a, 5, "c0250", "WARNING", "Structured"),
        ("category", a, 3, "c0250", "WARNING", "Structured"), ("category", a, 5, "c0250", "WARNING", "Structured"), ("rank", a, 3, "c0170", "ERROR", "x"),
        ("reference", a, 4, "0010", "WARNING", "b"), ("reference", a, 5, "0010", "WARNING", "c"), ("total", a, 0, "c0080", "WARNING", "16.00 / 11.00"),
        ("none said", a, 2, "c0250", "ERROR", "Vanilla"), ("none said", a, 3, "c0250", "ERROR", "Structured"), ("none said", a, 5, "c0250", "ERROR", "Structured"),
        ("list", a, 3, "c0140", "ERROR", "deposits"), ("list", a, 5, "c0140", "ERROR", "Bonds"),
        ("if type", a, 4, "c0250", "ERROR", ""), ("absent", b, 0, "c0777", "ERROR", ""),
    ]
    got = keys(run(spark, tmp_path, given, rules, lists))
    assert (set(got) - set(want), set(want) - set(got), len(got)) == (set(), set(), len(want))
    of_lists = [r[:3] for r in keys(run(spark, tmp_path, given, rules, lists, country=True)) if r[0] in ("list", "country")]
    assert of_lists == [("country", a, 3), ("list", a, 3)]
    assert [r[0] for r in keys(run(spark, tmp_path, {}, rules, required=["B01.00"]))] == ["SYS_001"]
    assert [r[:2] for r in keys(run(spark, tmp_path, given, [], required=["B99.00"]))] == [("SYS_002", "B99.00")]


def test_many_lists_are_one_join(spark):
    df = spark.createDataFrame([(1, "v03", "x"), (2, " v99 ", None), (3, "N/A", "y"), (4, "V03", "x")], "id int, a string, b string")
    allowed = spark.createDataFrame([("r1", f"v{i:02}") for i in range(30)] + [("r2", "x")], "rule_id string, value string")
    got = C.codelist_joins(df, [("r1", "a"), ("r2", "b"), ("r3", "b")], allowed, ["id"])
    told = "allowed: " + ", ".join(f"v{i:02}" for i in range(10)) + "..."
    assert sorted(map(tuple, got.collect())) == [(2, "r1", "v99", told), (3, "r2", "y", "allowed: x"), (4, "r1", "V03", told)]


def test_many_checks_are_one_scan(spark):
    """400 checks over seven words: found as the same checks one by one, and no projection that grows with them is one method."""
    df = spark.createDataFrame([(i, str(i % 7), None if i % 5 else "") for i in range(200)], "id int, a string, b string")
    make = [lambda i: C.plausibility(f"p{i}", "range_exclusive_min", "a", low=float(i % 9)), lambda i: C.mandatory(f"m{i}", "b", F.col("id") % (i + 1) == 0), lambda i: C.codelist(f"c{i}", "a", [str(i % 7)]), lambda i: C.not_negative(f"n{i}", "a")]
    checks = [make[i % 4](i) for i in range(400)]
    fused = C.fuse(df, checks, keys=["id"])
    got = {(r["rule_id"], r["id"], r["value"]) for r in fused.collect()}
    want = set()
    for i in range(400):
        for k in range(200):
            a = k % 7
            if i % 4 == 0 and not a > i % 9:
                want.add((f"p{i}", k, str(a)))
            if i % 4 == 1 and k % (i + 1) == 0:
                want.add((f"m{i}", k, ""))
            if i % 4 == 2 and a != i % 7:
                want.add((f"c{i}", k, str(a)))
    assert got == want
    plan = fused._jdf.queryExecution().executedPlan().toString()
    grown = [line for line in plan.split("\n") if re.search(r"Project .*(words of row#\d+|decimal of a#\d+)$|AS words of row|AS decimal of a", line)]
    assert grown and not any(re.match(r"[ :+-]*\*\(", line) for line in grown)


def test_first_seen(spark):
    rows = [(i, None if i % 11 == 0 else "hot" if i % 3 else f"k{i // 6}", "x" if i < 5 else "y", "o") for i in range(300)]
    df = spark.createDataFrame(rows, "id long, k string, v string, cell string")
    got = X.first_seen(df, {"u": ["k", "absent"], "w": ["id"], "n": ["absent"]}, {"d": ("k", "v"), "e": ("k", "absent")}, ["id"], ["id", "cell"])
    seen, want = {}, set()
    for i, k, v, _ in rows:
        if k is not None:
            if k in seen:
                want.add(("u", i, None))
                if seen[k] != v:
                    want.add(("d", i, v))
            seen.setdefault(k, v)
    assert {(r["rule_id"], r["id"], r["value"]) for r in got.collect()} == want and {r["cell"] for r in got.collect()} == {"o"}
    assert got.where("false").columns == ["id", "cell", "rule_id", "key", "value", "first_value"]
    assert X.first_seen(df, {}, {}, ["id"], ["id"]).count() == 0
    clash = df.select(F.col("k"), F.col("id").alias("range"), F.col("v").alias("nth"))
    told = X.repeated_keys(clash, ["k"], ["range"]).collect()
    assert {r["nth"] for r in told} <= {"x", "y"} and len(told) == sum(w[0] == "u" for w in want)
    assert X.repeated_keys(df, ["id"], ["k"]).count() == 0


def test_bitmap_filter(spark):
    parents = spark.range(0, 5_000, 2).select(F.col("id").cast("string").alias("v"))
    rows = spark.range(6_000).select(F.col("id"), F.when(F.col("id") % 10 > 0, F.col("id").cast("string")).alias("v"))
    for bitmaps in (1, 64):
        told = M.probed(rows, "v", M.bitmap_filter(parents, "v", bitmaps), "maybe", bitmaps).collect()
        assert len(told) == 6_000 and all(r["maybe"] for r in told if r["v"] and r["id"] % 2 == 0 and r["id"] < 5_000)
        assert sum(r["maybe"] for r in told) < (2_600 if bitmaps > 1 else 3_000) and not any(r["maybe"] for r in told if r["v"] is None)
    for filtered in (True, False):
        assert {r["id"] for r in X.unmatched(rows, "v", parents, "v", ["id"], filtered=filtered).collect()} == {i for i in range(6_000) if i % 10 and (i % 2 or i >= 5_000)}
    plan = X.unmatched(rows, "v", parents, "v", ["id"], filtered=True)._jdf.queryExecution().optimizedPlan().toString()
    assert "bitmap_construct_agg" in plan


def test_equality_keys(spark):
    texts = [None, "", " ", "1", "1.0", " 1,000 ", "1e3", "-0", "0", "abc", "ABC ", "ß", "SS", "1e999", "2e999", "n/a"]
    df = spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string")
    a, b = E.text(F.col("a")), E.text(F.col("b"))
    got = df.select("a", "b", E.eq(a, b).value.alias("eq"), E.equality_key(a).eqNullSafe(E.equality_key(b)).alias("key")).collect()
    assert all(r["eq"] == r["key"] for r in got)
    values = spark.createDataFrame([("1000",), ("Abc",), (None,)], "v string")
    told = {r["a"]: (r["inside"], r["outside"]) for r in M.in_table(df.select("a").distinct(), a, values, "v", outside="outside").collect()}
    assert {t for t, (i, _) in told.items() if i} == {" 1,000 ", "1e3", "abc", "ABC "} and told[None] == (False, False) and all(i != o for t, (i, o) in told.items() if t is not None)


def test_finite_numbers(spark):
    df = spark.createDataFrame([("1e999",), ("-1e999",), ("1.7",), ("x",), (None,), ("1,000",)], "a string")
    assert [r[0] for r in df.select(is_integer_text(F.col("a"))).collect()] == [False, False, True, False, False, True]
    assert [r[0] for r in df.select(is_finite(F.col("a").try_cast("double"))).collect()][:2] == [False, False]
    assert {(r["value"], r["severity"]) for r in C.fuse(df, [C.integer_text("i", "a", severity="ERROR")]).collect()} == {("1e999", "WARNING"), ("-1e999", "WARNING"), ("x", "WARNING")}


def test_runs_are_whole_or_not_there(spark, tmp_path):
    base = str(tmp_path / "runs")
    df = spark.createDataFrame([(i, "" if i % 3 else "x") for i in range(90)], "id long, a string")
    found = lambda n: C.fuse(df.where(F.col("id") < n), [C.mandatory("m", "a", rule_level="L1")], row="id")
    about = {"tables": ["B01.00"], "catalog_version": "1", "rule_count": 1}
    with pytest.raises(FileNotFoundError):
        sinks.committed(spark, base)
    broken = found(90).withColumn("message", F.when(F.col("row") == 88, F.raise_error(F.lit("lost"))).otherwise(F.col("message")))
    with pytest.raises(PySparkException):
        sinks.commit_run(broken, base, "a", **about)
    with pytest.raises(FileNotFoundError):
        sinks.committed(spark, base)
    sinks.commit_run(found(30), base, "a", **about)
    with pytest.raises(PySparkException):
        sinks.commit_run(broken, base, "a", **about)
    assert sinks.committed(spark, base).count() == 20
    summary = sinks.commit_run(found(90), base, "a", **about)
    sinks.commit_run(found(0), base, "b", **about)
    assert sinks.committed(spark, base).count() == 60 and sinks.committed(spark, base, "b").count() == 0
    assert report.totals(summary.counts, n="n").first().asDict() == {"total": 60, "errors": 60, "warnings": 0}
    told = {r["run_id"]: json.loads(r["manifest"])["issues"] for r in sinks.manifests(spark, base).collect()}
    assert told == {"a": {"by_severity": {"ERROR": 60}, "count": 60}, "b": {"by_severity": {}, "count": 0}}


def test_malformed_files(spark, tmp_path):
    (tmp_path / "B02.00.csv").write_text('0010;20\n1;2\n3;4;EXTRA;MORE\n5;"6;7"\n8\n')
    (tmp_path / "B03.00 x.csv").write_text('0010;20\n1;"2;;3"\n4\n')
    with pytest.warns(UserWarning, match=r"B02.00.csv has lines with more cells"):
        got = tables.read_directory(spark, str(tmp_path))
    assert list(got) == ["B03.00_x"] and [tuple(r) for r in got["B03.00_x"].collect()] == [("1", "2;;3"), ("4", None)]
    bad = f"file://{tmp_path}/B02.00.csv"
    told = tables.malformed_lines(spark, {bad: 2}).collect()
    assert [(r["line"], r["cells"], r["expected"], r["text"]) for r in told] == [(3, 4, 2, "3;4;EXTRA;MORE")]
    with pytest.raises(PySparkException, match="more than 2 cells"):
        tables.read_delimited(spark, bad, "0010;20").collect()
    assert tables.read_delimited(spark, bad, "0010;20", strict=False).count() == 4


def test_ranges_of_files(spark, tmp_path):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        for name, changed in (("one", None), ("two", 1_234)):
            (tmp_path / name).mkdir()
            (tmp_path / name / "t.csv").write_text("".join(f"line {'changed' if i == changed else i} {'x' * 20}\n" for i in range(2_000)))
            if changed:
                (tmp_path / name / "u.csv").write_text("more\n")
        one, two = (report.range_fingerprints(spark, str(tmp_path / n), lines=100) for n in ("one", "two"))
        assert one.count() == 20 and spark.read.text(str(tmp_path / "one")).rdd.getNumPartitions() > 5
        assert sorted(map(tuple, report.changed_ranges(one, two).collect())) == [("t.csv", 12, "changed"), ("u.csv", 0, "added")]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_diff_is_one_aggregate(spark):
    rows = lambda *keys: spark.createDataFrame([(k, "t", 1, "f", "ERROR") for k in keys], "rule_id string, template string, row long, field_code string, severity string")
    diff = report.issue_diff(rows("a", "a", "b", "c"), rows("a", "b", "b", "b"))
    assert sorted((r["rule_id"], r["side"]) for r in diff.collect()) == [("a", "expected"), ("b", "actual"), ("b", "actual"), ("c", "expected")]
    assert diff._jdf.queryExecution().sparkPlan().toString().count("HashAggregate") <= 2 and "Join" not in diff._jdf.queryExecution().optimizedPlan().toString()


def test_checks_of_rows_are_compiled(spark):
    """Lists and keys explode in generated code, and only texts in a date's shape are parsed: a failed parse is an exception inside Spark."""
    df = spark.createDataFrame([(1, "v1", "x"), (2, None, "y"), (3, "v1", "y")], "id long, a string, b string")
    allowed = spark.createDataFrame([("r", "v1"), ("q", "x")], "rule_id string, value string")
    of = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    for made in (C.codelist_joins(df, [("r", "a"), ("q", "b")], allowed, ["id"]), X.first_seen(df, {"u": ["a"]}, {"d": ("a", "b")}, ["id"], ["id"])):
        exploded = [line for line in of(made).split("\n") if "Generate explode(" in line]
        assert exploded and not any("lambda" in line for line in exploded)
    plan = of(df.select(parse_date(F.col("a")).alias("day")))
    assert plan.count("gettimestamp") == plan.count("RLIKE") == len(DATE_FORMATS)


def test_shapes_of_dates_leave_no_date_out(spark):
    parts = ["2024", "+2024", "12024", "+12024", "24", "1", "01", "001", "-1", "+1", "13", "31", "1x", "", "٣"]
    texts = [f"{a}{s}{b}{s}{c}" for s in "-./" for a in parts for b in parts for c in parts] + ["20240131", "+20240131", "120240131", "+120240131", "-20240131", "2024131", "2024-01-31 ", " 31.1.2024\n", "2024-01-31 12:00:00", "2024-01-31\n1", "1-2/2024"]
    df = spark.createDataFrame([(t,) for t in texts], "a string")
    plain = F.when(~is_missing(F.col("a")), F.coalesce(*[F.try_to_timestamp(stripped(F.col("a")), F.lit(f)) for f in DATE_FORMATS]).cast("date"))
    assert df.where(~parse_date(F.col("a")).eqNullSafe(plain)).collect() == [] and df.where(parse_date(F.col("a")).isNotNull()).count() > 20
