"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import stash


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b); component is the smallest node it can reach.

    Each step rewires links towards the smallest neighbour, so the links become stars in a number
    of rounds that grows with the logarithm of the longest path. All steps are joins and
    aggregations, and each round is a written table: nothing is collected, and a lost executor
    costs one round at most. It ends when a round changes no link. No links give no rows."""
    e = stash(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    n = e.count()
    while n:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*")
        now = stash(small.where("u <> v").distinct())
        m = now.count()
        same = m == n and now.join(e, ["u", "v"], "left_anti").isEmpty()
        e, n = now, m
        if same:
            break
    star = e.groupBy("u").agg(F.min("v").alias("component"))
    return star.withColumnRenamed("u", "node").unionByName(star.select(F.col("component").alias("node"), "component").distinct())
