"""Tables that all executors can read, and small helpers every operator uses.

Intermediate results that are read more than once are written as Parquet below
the folder named by ``spark.checkpoint.dir``.  A lost executor then costs only
the tasks it was running: what was written stays readable, and a relation read
from files carries its size, so Spark itself decides by its own threshold
whether a join side may be broadcast.
"""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SALTS = 16
#: a key is heavy if it holds more than this share of a table's rows; so fewer keys than its inverse are heavy
HEAVY = 0.001


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset one of our own in local mode, an error on a cluster."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spark-tabguard-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def saved(df: DataFrame, name: str, group_bytes: int = 0) -> DataFrame:
    """Write ``df`` below the shared folder and return the table read back.

    ``group_bytes`` bounds Parquet's row groups, for tables of very long rows,
    which are held in memory a group at a time.  Their size is then looked at
    after each row; by default Parquet does not before a hundred rows.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tabguard/{name}-{uuid.uuid4().hex}"
    bounds = {"parquet.block.size": group_bytes, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1} if group_bytes else {}
    df.write.option("compression", "zstd").options(**bounds).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` where null equals null; the result has the left keys and every other column."""
    own = {k: unused(left, f"right_{k}") for k in keys}
    renamed = right.withColumnsRenamed(own)
    on = [left[k].eqNullSafe(renamed[r]) for k, r in own.items()]
    return left.join(renamed, reduce(lambda a, b: a & b, on), how).drop(*own.values())


def unused(df: DataFrame, name: str) -> str:
    """``name``, or with a number behind it, so that no column of ``df`` has it in any case."""
    taken, out, n = {c.lower() for c in df.columns}, name, 0
    while out.lower() in taken:
        n += 1
        out = f"{name}_{n}"
    return out


def split_join(left: DataFrame, right: DataFrame, key: str | list[str], by: str, rows: int) -> DataFrame:
    """Inner join on ``key``, of which ``right`` has one row each, with ``n``, the number of its rows in ``left``.

    Rows of heavy keys are dealt over ``SALTS`` by a hash of ``by``.  The heavy
    keys are broadcast: of ``rows`` rows at most 1 / HEAVY keys are heavy.
    """
    keys = [key] if isinstance(key, str) else key
    heavy = F.col("n") > max(1.0, rows * HEAVY)
    hot = F.broadcast(right.where(heavy).select(*keys, F.lit(True).alias("_hot")))
    dealt = left.join(hot, keys, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).otherwise(0)).drop("_hot")
    sent = right.withColumn("_salt", F.explode(F.when(heavy, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return dealt.join(sent, [*keys, "_salt"]).drop("_salt")


def total(counts: DataFrame) -> int:
    """The sum of ``n``."""
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
