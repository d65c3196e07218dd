"""Membership in a table's values: a bounded bitmap before the shuffle, and equality keys for values that compare loosely."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabguard.functions.expressions import Val, equality_key
from tabguard.sources.scratch import unused

#: the bits of one bitmap as Spark's bitmap functions have it, and how many bitmaps a filter is at most: 8 MB
BITS, BITMAPS = 8 * 4096, 2048


def bitmap_filter(values: DataFrame, column: str, bitmaps: int = BITMAPS) -> DataFrame:
    """(bucket, bitmap) of the hashes of a column's values: ``bitmaps`` rows of 4 KB at most, whatever the table's size.

    Bits are set in partial aggregates, so a frequent value is one bit of each
    partition.  Of values that are not there some share their bit with one that
    is: the fuller the bitmaps, the more.
    """
    place = F.pmod(F.xxhash64(F.col(f"`{column}`")), F.lit(bitmaps * BITS)) + 1
    return values.where(F.col(f"`{column}`").isNotNull()).groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bitmap"))


def probed(rows: DataFrame, column: str, members: DataFrame, name: str, bitmaps: int = BITMAPS) -> DataFrame:
    """The rows with ``name``: false where the filter rules the value out, true where it may be there.

    The filter is broadcast: its size is bounded by ``bitmaps``.
    """
    place = F.pmod(F.xxhash64(F.col(f"`{column}`")), F.lit(bitmaps * BITS)) + 1
    bucket, bitmap = unused(rows, "bucket"), unused(rows, "bitmap")
    told = F.broadcast(members.select(F.col("bucket").alias(bucket), F.col("bitmap").alias(bitmap)))
    both = rows.join(told, F.bitmap_bucket_number(place) == F.col(f"`{bucket}`"), "left")
    at = F.bitmap_bit_position(place).cast("int")
    octet = F.conv(F.hex(F.substring(F.col(f"`{bitmap}`"), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return both.withColumn(name, F.coalesce(F.getbit(octet, at % 8) == 1, F.lit(False))).drop(bucket, bitmap)


def in_table(df: DataFrame, value: Val, values: DataFrame, column: str, name: str = "inside", outside: str | None = None) -> DataFrame:
    """The rows with whether their value equals any in a table's column, as ``expressions.is_in`` of a list would say; ``outside`` as ``not_in``.

    Numbers equal numbers and other texts equal texts without case, so both sides
    have one key, and any number of values is one equi-join, broadcast or split
    by Spark as their size asks.  Null is neither in nor not in; of a failed
    evaluation both are false.
    """
    key, there = unused(df, "key of value"), unused(df, "value is there")
    own = values.select(equality_key(Val(F.col(f"`{column}`").cast("string"), F.lit(False))).alias(key)).where(F.col(f"`{key}`").isNotNull()).distinct().withColumn(there, F.lit(True))
    known = ~value.err & value.value.isNotNull()
    both = df.withColumn(key, F.when(known, equality_key(value))).join(own, key, "left")
    found, asked = F.coalesce(F.col(f"`{there}`"), F.lit(False)), F.col(f"`{key}`").isNotNull()
    out = both.withColumns({name: asked & found} | ({outside: asked & ~found} if outside else {}))
    return out.drop(key, there)


def fits_in_memory(df: DataFrame) -> bool:
    """Whether Spark would broadcast the table by its own threshold and estimate."""
    session = df.sparkSession._jsparkSession
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) <= session.sessionState().conf().autoBroadcastJoinThreshold()

