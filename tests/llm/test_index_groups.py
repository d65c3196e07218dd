"""The row groups of tables whose rows are long, which are read a group at a time."""

import random

import pyarrow.dataset as ds
import pytest
from pyspark.sql import functions as F

from tabguard.llm import decontam, shared
from test_operators import prose


def groups(df):
    """Rows and bytes of each row group of a stored table."""
    return [(g.num_rows, g.total_byte_size) for part in ds.dataset([f.removeprefix("file://") for f in df.inputFiles()], format="parquet").get_fragments() for g in part.row_groups]


def test_long_rows_keep_to_the_bound(spark):
    rows = spark.range(0, 60, 1, 1).select("id", F.sequence(F.lit(1), F.when(F.col("id") < 3, 1).otherwise(50_000)).alias("v"))
    stored = shared.saved(rows, "groups", 1_000_000)
    assert sum(n for n, _ in groups(stored)) == 60 and max(size for _, size in groups(stored)) < 1_500_000
    assert sorted((r["id"], len(r["v"])) for r in stored.collect()) == [(i, 1 if i < 3 else 50_000) for i in range(60)]


@pytest.mark.parametrize("first", ["", "a b"])
def test_index_of_large_shards(spark, first):
    """A small shard before large ones does not put the bound off."""
    text = prose(random.Random(3), 400)
    long = (text + " ") * (2_100_000 // len(text) + 1)
    docs = spark.createDataFrame([(0, first)], "doc_id long, text string").unionByName(spark.range(1, 25, 1, 1).select(F.col("id").alias("doc_id"), F.lit(long).alias("text"))).coalesce(1)
    index = decontam.positional_index(docs)
    assert index.count() == 25 and sum(n for n, _ in groups(index)) == 25
    assert len(groups(index)) > 1 and max(size for _, size in groups(index)) < 1.5 * decontam.GROUP_BYTES
    bench = spark.createDataFrame([(1, " ".join(text.split()[20:40]))], "item_id long, text string")
    found = decontam.search(index, bench, slop=0)
    assert found.where(F.size("hits") > 0).count() == 24 and found.count() == 25
