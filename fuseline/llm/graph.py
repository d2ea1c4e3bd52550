"""Connected components of a graph given by its links, by alternating star operations.

Nothing of the graph comes to the driver but two sums for each round. A hub's links meet in joins
that adaptive execution splits, not in one group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fuseline.llm.common import stored


def _least(links: DataFrame) -> DataFrame:
    return links.groupBy("u").agg(F.min("v").alias("m"))


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """links: a, b (long), in any order, repeats allowed. Gives node and component, the smallest
    node that can be reached, for each node that has a link. Nulls and loops are dropped; no links
    give no rows."""
    now = links.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, seen = stored(now, "links"), None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both), "u").filter("v > u")
        large = large.select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        small = large.join(_least(large), "u")
        small = small.select("u", F.col("m").alias("v")).unionByName(small.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        now = stored(small.distinct(), "links")
        sign = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if tuple(sign) == seen:
            break
        seen = tuple(sign)
    else:
        raise RuntimeError("the components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def leads(links: DataFrame, names: DataFrame) -> DataFrame:
    """node and lead for each node of links (a, b): the least lead of the nodes that it reaches. names:
    node, lead (of any type with an order)."""
    comp = components(links)
    least = comp.join(names, "node").groupBy("component").agg(F.min("lead").alias("lead"))
    return comp.join(least, "component").select("node", "lead")
