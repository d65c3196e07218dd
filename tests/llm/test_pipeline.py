"""The pipeline's stages, each on its own input, and as a whole."""

import re

import pytest
from pyspark.sql import functions as F

from test_operators import docs, labels, local, prose, texts, words  # noqa: F401

corpus_pipeline = pytest.importorskip("corpus_pipeline")
CLASHES = ("digest", "row_id", "key", "id", "band", "base", "candidates", "copy", "size", "total", "_key", "component", "n", "kept", "shard", "hits")


@pytest.fixture(scope="module")
def sf(spark, docs, labels, texts, tmp_path_factory):  # noqa: F811
    """A folder of small tables; half of the labels are of good documents."""
    path = tmp_path_factory.mktemp("sf")
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(path / "documents.parquet"))
    labels.write.parquet(str(path / "labels.parquet"))
    spark.createDataFrame([(1, " ".join(texts[9].split()[100:130])), (2, None), (3, "")], "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path)


def clashing(df):
    return df.withColumns({c: F.lit(c) for c in CLASHES if c not in df.columns})


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "secrets", "mixing"]


@pytest.mark.parametrize("name", ["quality", "near_duplicates", "decontamination", "secrets", "mixing"])
def test_stage(spark, docs, texts, sf, name):  # noqa: F811
    """Nulls, empty and repeated rows, clashing columns and an empty table go through every stage."""
    stage = dict(corpus_pipeline.STAGES)[name]
    given = clashing(docs)
    out = stage(spark, given, sf)
    assert out.columns[: len(given.columns)] == given.columns and len(out.columns) == len(given.columns) + (name == "mixing")
    rows = out.collect()
    assert all(r[c] == c for r in rows for c in CLASHES if c not in docs.columns)
    found, all_rows = sorted((str(r["doc_id"]), r["text"]) for r in rows if r["text"]), [(i, t) for i, t in local(docs)]
    if name == "quality":
        assert all(words(r["text"]) or r["text"].strip() for r in rows) and set(found) <= {(str(i), t) for i, t in all_rows}
        assert all(found.count(f) == sum((str(i), t) == f for i, t in all_rows) for f in found)
    elif name == "near_duplicates":
        assert len({t for _, t in found}) == len(found) and sum(r["text"] in (None, "") for r in rows) == 1
    elif name == "decontamination":
        part = " ".join(texts[9].split()[100:130])
        assert len(rows) == sum(part not in (t or "") for _, t in all_rows) < len(all_rows)
    elif name == "secrets":
        assert sorted((str(r["doc_id"]), str(r["text"])) for r in rows) == sorted((str(i), re.sub("[0-9a-f]{16,}", "[SECRET]", str(t))) for i, t in all_rows)
    else:
        size = lambda t: len(re.findall(r"[^\\x20\\x09-\\x0D]+", t or ""))
        assert out.columns[-1] == "copy_1" and 0 < sum(size(r["text"]) for r in rows) <= 3 * sum(size(t) for _, t in all_rows)
    assert stage(spark, given.limit(0), sf).count() == 0


def test_secrets_go_and_clean_texts_stay(spark, sf):
    rows = [(1, "the password = 'abcdefghijkl0' here", 35), (2, None, None), (3, "", 0), (4, "nothing here", 12), (4, "nothing here", 12), (5, "x " * 50_000 + "token: 0123456789abcdefABCDEF", 7)]
    out = dict(corpus_pipeline.STAGES)["secrets"](spark, spark.createDataFrame(rows, "doc_id long, text string, n_chars int"), sf).orderBy("doc_id").collect()
    assert [r["text"] for r in out[:5]] == ["the [SECRET]' here", None, "", "nothing here", "nothing here"] and out[5]["text"].endswith("x [SECRET]")
    assert [r["n_chars"] for r in out] == [18, None, 0, 12, 12, len(out[5]["text"])]


def test_run(spark, docs, sf):  # noqa: F811
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "copy"]
    step = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        step = corpus_pipeline.saved(stage(spark, step, sf), "pipeline-test")
    key = lambda df: sorted(map(str, df.collect()))
    assert key(out) == key(step)
