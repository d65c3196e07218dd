"""Value semantics on tiny tables."""

import pytest
from pyspark.sql import functions as F

from tabguard.functions import expressions as E
from tabguard.functions import predicates as P
from tabguard.issues import ISSUE_COLUMNS
from tabguard.operators import business as B
from tabguard.operators import checks as C
from tabguard.operators import contract, cross, report
from tabguard.plans.validation import assertion, validate
from tabguard.sources import tables


def one(spark, column, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_missing_texts(spark):
    assert one(spark, P.is_missing(F.col("v")), None, "", " N/A\t", "NaT", "None", "0", "n.a.") == [True, True, True, True, True, False, False]


def test_numbers_and_commas(spark):
    assert one(spark, P.decimal_comma_double(F.col("v")), "1,5", "1.5", "abc", "NaN", "1.0d", "inf", None) == [1.5, 1.5, None, None, None, None, None]
    assert one(spark, P.grouped_double(F.col("v")), "1,234.5", "1,5", ".5", "5.", "1e3", "0x1p3") == [1234.5, 15.0, 0.5, 5.0, 1000.0, None]


def test_dates(spark):
    got = one(spark, P.parse_date(F.col("v")), "2024-1-5", "5.1.2024", "05/01/2024", "20240105", "2024-02-30", "2024-01-05 10:00:00", "NA")
    assert [str(d) if d else None for d in got] == ["2024-01-05"] * 4 + [None] * 3


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [(None, None, True), (None, "x", False), ("1,000", "1000.0", True), (" Straße", "STRASSE", True), ("", None, False), ("1", "01", True), ("a", "b", False)],
)
def test_equality(spark, a, b, same):
    row = spark.range(1).select(E.eq(E.text(F.lit(a).cast("string")), E.text(F.lit(b).cast("string"))).value.alias("eq"), E.ne(E.text(F.lit(a).cast("string")), E.text(F.lit(b).cast("string"))).value.alias("ne")).first()
    assert (row["eq"], row["ne"]) == (same, not same)


def test_errors_skip_and_short_circuit(spark):
    t = lambda x: E.text(F.lit(x).cast("string"))
    zero = E.div(t("1"), t("0"))
    ok, bad = E.eq(t("a"), t("a")), E.gt(zero, t("1"))
    row = spark.range(1).select(bad.err, E.and_(E.not_(ok), bad).err, E.or_(ok, bad).err, E.and_(ok, bad).err, E.violated(None, bad), E.violated(None, E.not_(ok)), E.violated(bad, E.not_(ok)), E.violated(ok, None)).first()
    assert list(row) == [True, False, False, True, False, True, False, False]


def test_null_is_in_nothing(spark):
    n, items = E.text(F.lit(None).cast("string")), [E.text(F.lit("a"))]
    assert list(spark.range(1).select(E.is_in(n, items).value, E.not_in(n, items).value, E.gt(n, items[0]).value).first()) == [False, False, False]


def test_fused_checks_read_once(spark):
    df = spark.createDataFrame([(2, "", "x"), (3, "1", "Not applicable")], "row bigint, a string, b string")
    found = C.fuse(df, [C.mandatory("m", "a"), C.codelist("c", "b", ["y"]), C.not_negative("n", "a")], row="row")
    assert [(r["rule_id"], r["row"], r["field_code"], r["value"]) for r in found.orderBy("rule_id").collect()] == [("c", 2, "b", "x"), ("m", 2, "a", "")]
    assert tuple(found.columns) == ISSUE_COLUMNS
    assert C.fuse(df, []).count() == 0 and len(C.fuse(df, [C.mandatory(f"m{i}", "a") for i in range(120)]).collect()) == 120


def test_formula_with_negative_operands(spark):
    df = spark.createDataFrame([("7", "5", "-2"), ("3", "5", "-2"), ("3", "5", None)], "r string, a string, b string")
    found = C.fuse(df, [C.sum_formula("f", "r", [(1, "a"), (-1, "b")])]).collect()
    assert [r["value"] for r in found] == ["3.00 (expected: 7.00)"]


def test_first_value_conflicts(spark):
    df = spark.createDataFrame([(1, "k", "a"), (2, "k", "b"), (3, "k", "a"), (4, None, "z"), (5, "q", "N/A")], "row int, k string, v string")
    assert [(r["row"], r["value"]) for r in B.first_value_conflicts(df, "k", "v", ["row"], ["row"]).collect()] == [(2, "b")]


def test_overlap_four_cases(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "c0020 string")
    found = lambda **t: cross.counted_twice({f"B02.00{k.removeprefix('plain')}": v for k, v in t.items()}, "B02.00", "c0020", [])
    values = lambda df: [r["value"] for r in df.collect()]
    assert values(found(_TypeA=ids("ID-1", "ID-2"), _TypeB=ids("ID-2", "ID-3"))) == ["ID-2"]
    assert values(found(_TypeA=ids("ID-1", "ID-2"), _TypeB=ids("ID-3", "ID-4"))) == []
    assert found(_TypeA=ids("ID-1", "ID-2")) is None
    assert values(found(plain=ids("ID-9"), _TypeB=ids("ID-9"))) == ["ID-9"]
    assert values(found(plain=ids("ID-9"), _TypeA=ids("ID-1"), _TypeB=ids("ID-9"))) == []
    assert values(cross.overlapping(ids(), ids("ID-2"), "c0020", [])) == []


def test_absent_columns(spark):
    """A run over a table that lacks what its rules look at besides their own field."""
    df = spark.createDataFrame([(2, "5", "x"), (3, None, "1")], "row bigint, a string, b string")
    t = lambda x: E.text(F.lit(x))
    checks = [C.plausibility("p", "lte", "a", "zz"), C.conditional_mandatory("c", "a", "zz", "missing"), C.isin_if_typed("i", "b", "zz"), C.codelist("l", "zz", ["v"]), C.mandatory("m", "zz"), C.gated(C.mandatory("g", "a"), E.or_(E.eq(E.field("b"), t("1")), E.eq(E.field("zz"), t("1")))), assertion("s", "zz", E.eq(E.field("zz"), t("1")), E.is_not_null(E.field("a")))]
    got = validate(spark, {"B02.00": df}, {"B02.00": checks})
    assert sorted((r["rule_id"], r["row"] or 0) for r in got.collect()) == [("g", 3), ("i", 2), ("i", 3), ("m", 0)]


def test_run_times_and_ids(spark):
    found = C.fuse(spark.createDataFrame([("",)], "a string"), [C.mandatory("m", "a")])
    one = report.manifest(found, ["B02.00"], "1.5", 42, "in", "csv_dir", "h", "2024-01-01T00:00:00Z", "2024-01-01T00:01:00Z").first()
    assert (one["started_at"], one["finished_at"], one["input"]["path"], one["issues"]["count"]) == ("2024-01-01T00:00:00Z", "2024-01-01T00:01:00Z", "in", 1)
    assert one["run_id"] == report.run_id("in", "2024-01-01T00:00:00Z") != report.run_id("in", "2024-01-02T00:00:00Z")


def test_repeated_keys_of_a_hot_key(spark):
    rows = [("hot", "a", i) for i in range(400)] + [(f"k{i % 60}", "b", 1000 + i) for i in range(90)] + [(None, "a", 1), ("N/A", "a", 2), ("NA", "a", 3)]
    got = cross.repeated_keys(spark.createDataFrame(rows, "k string, j string, i int").repartition(5), ["k", "j", "absent"], ["i"])
    assert got.columns == ["k", "j", "i", "occurrence"]
    want = [("hot", "a", i, i + 1) for i in range(1, 400)] + [(f"k{i % 60}", "b", 1000 + i, 2) for i in range(60, 90)]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_totals_disabled_by_bad_value(spark):
    a, b = (spark.createDataFrame([(x,) for x in v], "v string") for v in (["1,000", "5"], ["1"]))
    assert cross.totals_differ(a, "v", b, "v").first()["total_a"] == 1005.0
    assert cross.totals_differ(a.union(spark.createDataFrame([("x",)], "v string")), "v", b, "v").count() == 0


def test_contract(spark):
    assert [r["rule_id"] for r in validate(spark, {}, {}).collect()] == ["SYS_001"]
    df = spark.createDataFrame([("a",)], "c9999 string")
    want = spark.createDataFrame([("B99.00", "c0010", True), ("B99.00", "c0020", False)], "table string, field_code string, mandatory boolean")
    got = contract.structure_issues(spark, {"B99.00": df, "B77.99": df}, want)
    assert sorted((r["rule_id"], r["template"], r["field_code"]) for r in got.collect()) == [("STRUCT_001", "B77.99", ""), ("STRUCT_002", "B99.00", "c9999"), ("STRUCT_003", "B99.00", "c0010")]


def test_golden_keys(spark):
    """A mandatory field left blank, and two texts that are not in their lists, all in row 2."""
    df = spark.createDataFrame([(2, None, "FantasyType", "Non-Structured/Vanilla")], "row bigint, c0030 string, c0140 string, c0250 string")
    checks = {"B02.00": [C.mandatory("g1", "c0030"), C.codelist("g2", "c0140", ["Deposits"]), C.codelist("g3", "c0250", ["Non-structured/Vanilla"]), C.mandatory("g4", "c0999")]}
    keys = [tuple(r) for r in validate(spark, {"B02.00": df}, checks).select(*report.ISSUE_KEY).orderBy("rule_id").collect()]
    assert keys == [("g1", "B02.00", 2, "c0030", "ERROR"), ("g2", "B02.00", 2, "c0140", "ERROR"), ("g3", "B02.00", 2, "c0250", "ERROR"), ("g4", "B02.00", None, "c0999", "ERROR")]


def test_headers_and_keys():
    assert tables.normalised_names(["0010", "10", "c0020", "foo", "foo", "foo"]) == ["c0010", "c0010_1", "c0020", "foo", "foo_1", "foo_2"]
    assert [tables.table_key(n) for n in ("B02.00.csv", "B02.00_TypeA.csv", "B02.00 TypeA.CSV", "x.csv")] == ["B02.00", "B02.00_TypeA", "B02.00_TypeA", None]
    with pytest.raises(ValueError):
        tables.family({}, "")


def test_text_files(spark, tmp_path):
    (tmp_path / "B03.00.csv").write_text("")
    (tmp_path / "B04.00.csv").write_text("\n\n")
    (tmp_path / "B05.00.csv").write_text('0010;20\n1;"two\nlines"\n')
    (tmp_path / "B02.00.csv").write_text("﻿0010;20;0010\n001;;x\n\n002;nan;y\n", encoding="utf-8")
    with pytest.warns(UserWarning, match="B04.00"):
        got = tables.read_directory(spark, str(tmp_path))
    assert sorted(got) == ["B02.00", "B05.00"] and got["B05.00"].count() == 2
    whole = tables.read_directory(spark, str(tmp_path), quoted_breaks=True)
    assert [tuple(r) for r in whole["B05.00"].collect()] == [("1", "two\nlines")] and whole["B02.00"].count() == 2
    assert [tuple(r) for r in got["B02.00"].collect()] == [("001", None, "x"), ("002", None, "y")]
    assert got["B02.00"].columns == ["c0010", "c0020", "c0010_1"]


def test_row_numbers_over_splits(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(2000).selectExpr("id", "repeat('x', 50) AS pad").repartitionByRange(5, "id").sortWithinPartitions("id").write.parquet(path)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = tables.with_row_numbers(spark.read.parquet(path)).select("id", "row").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert all(r["row"] == r["id"] + 2 for r in got) and len(got) == 2000


def test_fingerprint_ignores_order(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "i int, s string")
    assert report.fingerprint(df).first() == report.fingerprint(df.orderBy(F.desc("i"))).first()
    assert report.fingerprint(df).first() != report.fingerprint(df.distinct()).first()
    rows = [("a|b", "c"), ("a", "b|c"), (None, "x"), ("~", "x"), ("", "x"), ("1:a", None), ("1", "a-")]
    assert len({report.fingerprint(spark.createDataFrame([r], "s string, t string")).first()["digest"] for r in rows}) == len(rows)


def test_file_fingerprint(spark, tmp_path):
    def digest(**files):
        base = tmp_path / f"{len(list(tmp_path.iterdir()))}"
        for name, text in files.items():
            (base / name).mkdir(parents=True)
            (base / name / "t.csv").write_text(text)
        return tuple(report.file_fingerprint(spark, str(base)).first())

    assert digest(a="1", b="2") == digest(b="2", a="1") and digest(a="1")[0] == 1
    assert len({digest(a="1", b="2"), digest(a="2", b="1"), digest(a="1", c="2"), digest(a="1")}) == 4


def test_checks_on_a_stream(spark, tmp_path):
    spark.createDataFrame([(1, ""), (2, "x")], "id int, a string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id int, a string").parquet(str(tmp_path / "in"))
    q = C.fuse(stream, [C.mandatory("m", "a")], keys=["id"]).writeStream.format("memory").queryName("found").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [r["id"] for r in spark.table("found").collect()] == [1]
