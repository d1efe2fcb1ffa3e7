"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestary.session import stage, unstage


def components(links: DataFrame) -> DataFrame:
    """``node, root`` of every node with links ``u, v``; ``root`` is the smallest node it reaches.

    Large and small stars in turn until the links no longer change. Every round is two joins on
    minima that are aggregated before they are shuffled; a hub's links are never gathered in one
    cell, and no node or link reaches the driver.
    """
    edges = stage(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                  .where("u > v").distinct(), "links")
    state = None
    while True:
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u and v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = (small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
                 .union(low.select("u", F.col("m").alias("v"))).distinct())
        before, edges = edges, stage(small, "links")
        unstage(before)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now
