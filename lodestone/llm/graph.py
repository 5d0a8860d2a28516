"""Connected components over a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


#: Parts that the links of a node are dealt to, so that a node with very many is no single task's work.
PARTS = 16


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (columns a and b, long): root is the smallest node reachable.

    Large-star and small-star steps alternate until the links are stars; each step is written out. Joins shuffle, whatever
    size a table has, so nothing that grows with the links is broadcast. An empty table of links gives an empty result.
    """
    edges = materialise(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    state = lambda e: e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before, after = None, state(edges)
    part = F.pmod(F.xxhash64("v"), F.lit(PARTS)).cast("int").alias("part")
    while after[0] and after != before:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lows = both.groupBy("u", part).agg(F.min("v").alias("v")).groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        dealt = lows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
        large = both.filter("v > u").select("u", "v", part).join(dealt.hint("merge"), ["u", "part"]).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v")
        lows = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lows.hint("merge"), "u").select(F.col("v").alias("x"), "m").unionByName(lows.select(F.col("u").alias("x"), "m"))
        edges = materialise(small.filter("x <> m").select(F.col("x").alias("u"), F.col("m").alias("v")).distinct())
        before, after = after, state(edges)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
