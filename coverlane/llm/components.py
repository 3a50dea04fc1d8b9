"""Connected components by alternating large-star and small-star steps.

Every step is a minimum per node and a join, so a round costs in proportion to the links,
and the number of rounds grows with the logarithm of the largest component. Minima are
written before they are joined: both sides of the join are then plain tables, and Spark can
split a node that has very many links.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coverlane.session import settle


def _ordered(a: Column, b: Column) -> list[Column]:
    return [F.greatest(a, b).alias("a"), F.least(a, b).alias("b")]


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())


def components(links: DataFrame, one: str, other: str) -> DataFrame:
    """``node, component`` for every node of a link, the component named by its smallest node.

    Links have no direction; repeated links and links of a node to itself or to null change
    nothing. No links give no rows.
    """
    now = settle(links.select(*_ordered(F.col(one), F.col(other))).where("a > b").distinct(), "links")
    mark = _mark(now)
    while mark[0]:
        both = now.select("a", "b").unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = settle(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")), "least")
        large = settle(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                       .distinct(), "large")
        least = settle(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = settle(small.unionAll(least.select("a", F.col("m").alias("b"))).distinct(), "links")
        mark, before = _mark(now), mark
        if mark == before:
            break
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
