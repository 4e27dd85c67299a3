"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headway.llm.shared import drop_stored, stored


def _stamp(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(node, component), stored, of every linked node of (a, b); a component is named by its smallest node.

    Every step keeps the components and shortens paths to the smallest node; a hub's links are joined
    to one row, so that a skewed join can split them.  Ends when a round changes nothing.
    """
    edges = stored(spark, links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = _stamp(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large, old = stored(spark, large), edges
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(down.select("u", F.col("m").alias("v"))).distinct()
        edges = stored(spark, small)
        drop_stored(spark, old, large)
        now = _stamp(edges)
        if now == before:
            break
        before = now
    out = stored(spark, edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))
    drop_stored(spark, edges)
    return out
