"""Connected components of a link table, by contraction with Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabguard.llm.shared import saved


def _flat(hooks: DataFrame) -> DataFrame:
    """(key, component) where every component is its own, by pointer jumping: paths halve with each step."""
    while True:
        over = hooks.select(F.col("key").alias("_key"), F.col("component").alias("_jump")).where("_key <> _jump")
        step = hooks.join(over, hooks["component"] == over["_key"], "left")
        step = saved(step.select("key", F.coalesce("_jump", "component").alias("component"), F.col("_jump").isNotNull().alias("moved")), "hooks")
        hooks = step.select("key", "component")
        if step.where("moved").isEmpty():
            return hooks


def components(links: DataFrame) -> DataFrame:
    """(a, b) links to (key, component): the smallest key that a key is linked to, over any way.

    Each round every key hooks to its smallest neighbour, trees of hooks are
    flattened, and links are drawn again between the roots alone.  A key that is
    smaller than all its neighbours either takes all of them or has a smaller
    neighbour in the next round, so two rounds at least halve the roots that
    still have links, and tables shrink accordingly.  There is no limit of
    rounds.  Links of a key to itself and repeated links change nothing, links
    with a null end are none.  Only keys that have links are listed; no links,
    no rows.
    """
    pair = F.struct(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).alias("p")
    edges = saved(links.where("a <> b").select(pair).distinct().select("p.*"), "links")
    levels: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy(F.col("a").alias("key")).agg(F.min("b").alias("least")).select("key", F.least("key", "least").alias("component"))
        levels.append(_flat(saved(hooks, "hooks")))
        root = levels[-1]
        drawn = edges.join(root.select(F.col("key").alias("a"), F.col("component").alias("_a")), "a").join(root.select(F.col("key").alias("b"), F.col("component").alias("_b")), "b")
        drawn = drawn.where("_a <> _b").select(F.struct(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).alias("p"))
        edges = saved(drawn.distinct().select("p.*"), "links")
    if not levels:
        return edges.select(F.col("a").alias("key"), F.col("b").alias("component"))
    out = levels.pop()
    while levels:
        below = levels.pop()
        above = out.select(F.col("key").alias("_key"), F.col("component").alias("_root"))
        out = saved(below.join(above, below["component"] == above["_key"], "left").select("key", F.coalesce("_root", "component").alias("component")), "labels")
    return out
