"""Operator 9: mix sources to target weights by systematic sampling.

Every document of a source is to appear ``rate = target / source size`` times
on average.  Documents of a source are laid out along a line, each taking a
piece of length ``rate`` (the prefix sum of expected copies); one random offset
per source shifts a comb of integer marks, and a document is emitted once per
mark in its piece.  It so appears floor(rate) or ceil(rate) times.  Along the
line documents lie by size, which keeps the words taken within about one
document of the target.

No window covers a whole source: ranks are made of three sums, over sizes of a
source, over hash cells of one size, and over rows of one cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabguard.llm.shared import joined, partitions, saved, table, unused

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
CELL_DIGITS = 2
SEED = "mix-1"
TOKEN = r"[^\x20\x09-\x0D]+"


def _unit(text: Column) -> Column:
    """Text to a double in [0, 1), the same in every run."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def running(rows: DataFrame, order: list[Column], **sums: str) -> DataFrame:
    """Add, under each new name, the sum of a column over all rows before, in a total order.

    Rows are dealt by ranges of the order; the ranges' own sums, as many as
    there are shuffle partitions, give the rest.  No task holds all rows.
    """
    spark, part = rows.sparkSession, "range_of_row"
    dealt = saved(rows.repartitionByRange(partitions(spark), *order).withColumn(part, F.spark_partition_id()), "mix-ranges")
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    of_range = dealt.groupBy(part).agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    of_range = of_range.select(part, *[before(f"_{n}", W.orderBy(part)).alias(f"_{n}") for n in sums])  # one row a range
    own = W.partitionBy(part).orderBy(*order)
    out = dealt.withColumns({n: before(c, own) for n, c in sums.items()}).join(of_range, part)
    return out.withColumns({n: F.col(n) + F.col(f"_{n}") for n in sums}).drop(part, *[f"_{n}" for n in sums])


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, target) from (source, size) rows.

    Sources in code point order, null last, take ``weights`` in turn.  Targets
    share the sum of all sizes by weight, capped at ``max_repeats`` times the
    source's size: sorted by the level at which they reach their cap, the
    sources before the first uncapped one are full and the rest share what is
    left.  This is the fixed point of resharing the excess.  One row per source;
    sources may be as many as web hosts.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size")).withColumn("one", F.lit(1).cast("long"))
    per = running(per, [F.col("source").asc_nulls_last()], place="one")
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("long"))
    per = per.withColumn("cap", F.lit(max_repeats).cast("long") * F.col("source_size"))
    per = running(per, [F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()], caps="cap", weights="weight")
    whole = per.agg(F.sum("source_size").alias("all_size"), F.sum("weight").alias("all_weight"))  # one row
    per = per.join(whole).withColumns({"rest": F.col("all_size") - F.col("caps"), "rest_weight": F.col("all_weight") - F.col("weights")})
    per = saved(per.withColumn("full", F.col("cap") * F.col("rest_weight") < F.col("rest") * F.col("weight")), "mix-levels")
    share = F.min(F.struct(F.col("cap") / F.col("weight"), "rest", "rest_weight"))
    first = per.where("NOT full").agg(share.alias("s")).select(F.col("s.rest").alias("first_rest"), F.col("s.rest_weight").alias("first_weight"))  # one row
    open_target = F.col("first_rest").cast("double") * F.col("weight").cast("double") / F.col("first_weight").cast("double")
    return per.join(first).select("source", "source_size", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.coalesce(open_target, F.lit(0.0))).alias("target"))


def ranked(rows: DataFrame) -> DataFrame:
    """Add ``place``, 1 to n within each source, by size, then hash of ``key``."""
    cells = rows.groupBy("source", "size", "cell").agg(F.count("*").alias("n"))
    in_size = W.partitionBy("source", "size").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.withColumn("before_cell", F.coalesce(F.sum("n").over(in_size), F.lit(0)))
    by_size = cells.groupBy("source", "size").agg(F.sum("n").alias("n"))
    in_source = W.partitionBy("source").orderBy("size").rowsBetween(W.unboundedPreceding, -1)
    by_size = by_size.select("source", "size", F.coalesce(F.sum("n").over(in_source), F.lit(0)).alias("before_size"))
    starts = joined(cells, by_size, ["source", "size"]).select("source", "size", "cell", (F.col("before_cell") + F.col("before_size")).alias("start"))
    out = joined(rows, saved(starts, "mix-starts"), ["source", "size", "cell"])
    in_cell = W.partitionBy("source", "size", "cell").orderBy("key", "doc_id")
    return out.withColumn("place", F.col("start") + F.row_number().over(in_cell)).drop("start")


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: str = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) for each row of ``docs``.

    Size is the number of words (null text: 0).  Null sources are one source.
    Rows of size 0 in a source without words get 0 copies.  Repeated rows are
    ranked apart; rows that agree in doc_id, source and size are alike.  Rows
    without a doc_id are told apart by their texts.  Other columns are not
    looked at.  An empty table gives an empty plan.  Reruns agree: nothing depends on order
    or partitions.
    """
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit("")))
    rows = docs.select(
        F.col("doc_id"),
        F.col("source"),
        F.coalesce(F.regexp_count(F.col("text"), F.lit(TOKEN)), F.lit(0)).cast("long").alias("size"),
        digest.alias("key"),
        F.substring(digest, 1, CELL_DIGITS).alias("cell"),
    )
    rows = saved(rows, "mix-sizes")
    targets = saved(source_targets(rows, weights, max_repeats), "mix-targets")
    out = joined(ranked(rows), targets, ["source"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    offset = _unit(F.concat_ws(":", F.lit(seed), F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))))
    marks = lambda k: F.floor(rate * k + offset)
    copies = F.least(marks(F.col("place")) - marks(F.col("place") - 1), F.lit(max_repeats).cast("long"))
    return out.select("doc_id", "source", "size", "key", "source_size", "target", copies.cast("long").alias("copies"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: str = SEED) -> DataFrame:
    """The documents themselves, each as often as the plan takes it, with ``copy`` from 1.

    Repeated rows of one (doc_id, source, size) share their copies evenly: the
    plan's copies of such a set are summed and dealt to the rows in turn.  All
    columns stay as they are; where one is named ``copy`` already the new one is
    ``copy_1``.  Null and empty texts have size 0 and are no words to take, null
    sources are one source.  An empty table has no rows.
    """
    plan = mix_plan(docs, weights, max_repeats, seed)
    copy, size, total, alike, turn, copies = (unused(docs, n) for n in ("copy", "size", "total", "alike", "turn", "copies"))
    taken = plan.groupBy("doc_id", "source", F.col("size").alias(size)).agg(F.sum("copies").alias(total), F.count("*").alias(alike))
    taken = saved(taken, "mix-copies")
    sized = docs.withColumn(size, F.coalesce(F.regexp_count(F.col("text"), F.lit(TOKEN)), F.lit(0)).cast("long"))
    keys = ["doc_id", "source", size]
    own = list(docs.columns)
    single = joined(sized, taken.where(F.col(alike) == 1), keys).select(*own, F.col(total).alias(copies))
    many = joined(sized, taken.where(F.col(alike) > 1), keys)
    many = many.withColumn(turn, F.row_number().over(W.partitionBy(*keys).orderBy(F.md5(F.coalesce(F.col("text"), F.lit(""))))))
    dealt = lambda k: F.floor(F.col(total) * k / F.col(alike))
    many = many.select(*own, (dealt(F.col(turn)) - dealt(F.col(turn) - 1)).alias(copies))
    every = single.unionByName(many).where(F.col(copies) > 0)
    return every.select(*own, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int"))).alias(copy))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mix_plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


ORACLE_SQL = """
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), text, '')) AS k
  FROM documents),
per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight
  FROM sized GROUP BY source),
caps AS (SELECT *, 3 * source_size AS cap, sum(source_size) OVER () AS total, sum(weight) OVER () AS all_weight FROM per),
levels AS (
  SELECT *, total - coalesce(sum(cap) OVER before, 0) AS rest, all_weight - coalesce(sum(weight) OVER before, 0) AS rest_weight
  FROM caps WINDOW before AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
flags AS (SELECT *, cap * rest_weight < rest * weight AS filled FROM levels),
first_open AS (SELECT rest, rest_weight FROM flags WHERE NOT filled ORDER BY cap / weight, rest, rest_weight LIMIT 1),
targets AS (
  SELECT f.source, f.source_size,
         CASE WHEN f.filled THEN CAST(f.cap AS DOUBLE)
              ELSE coalesce(CAST(o.rest AS DOUBLE) * CAST(f.weight AS DOUBLE) / CAST(o.rest_weight AS DOUBLE), 0.0) END AS target
  FROM flags f LEFT JOIN first_open o ON true),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, k, doc_id) AS place FROM sized),
rated AS (
  SELECT p.doc_id, p.size, t.source_size, t.target, p.place,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
         CAST(CAST('0x' || substr(sha256('mix-1:' || coalesce('s' || p.source, 'n')), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 AS u
  FROM placed p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(least(floor(rate * place + u) - floor(rate * (place - 1) + u), 3) AS BIGINT) * size AS taken
FROM rated
"""
