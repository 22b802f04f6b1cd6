"""Connected components by alternating large and small stars, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.storage import Scratch


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """node, label of every end of edges (u, v: long): label is the smallest node reachable.

    Every round is written, so a lost executor repeats one round at most, and the rounds grow with the
    logarithm of the longest path. Hubs are aggregated before a shuffle and split in joins.
    """

    def state(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    now = scratch.keep(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while (found := state(now)) != before:
        before = found
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        large = scratch.keep(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
        old, now = now, scratch.keep(small.filter("u <> v").distinct(), "small")
        scratch.drop(old)
        scratch.drop(large)
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionAll(now.select(F.col("v"), F.col("v")).distinct())
