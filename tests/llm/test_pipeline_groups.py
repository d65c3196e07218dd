"""The pipeline's decontamination over long texts, whose index is read a row group at a time."""

import random

import pytest
from pyspark.sql import functions as F

from tabguard.llm import decontam
from test_index_groups import groups
from test_operators import prose

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stage_reads_bounded_groups(spark, tmp_path, monkeypatch):
    made, index = [], decontam.positional_index
    monkeypatch.setattr(decontam, "positional_index", lambda docs: made.append(index(docs)) or made[-1])
    text = prose(random.Random(4), 400)
    other = prose(random.Random(5), 400)
    long = F.when(F.col("doc_id") % 3 == 0, F.lit((text + " ") * (2_100_000 // len(text) + 1))).otherwise(F.lit((other + " ") * (2_100_000 // len(other) + 1)))
    docs = spark.range(0, 24, 1, 1).select(F.col("id").alias("doc_id")).withColumn("text", long)
    spark.createDataFrame([(1, " ".join(text.split()[20:40]))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = dict(corpus_pipeline.STAGES)["decontamination"](spark, docs, str(tmp_path))
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == [i for i in range(24) if i % 3]
    assert sum(n for n, _ in groups(made[0])) == 24 and len(groups(made[0])) > 1
    assert max(size for _, size in groups(made[0])) < 1.5 * decontam.GROUP_BYTES
