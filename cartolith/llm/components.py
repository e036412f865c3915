"""Connected components of links between ids, in rounds written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolith.llm.common import discard, written


def state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.count_distinct("a")).first())


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in links (a, b): the smallest id that it reaches.

    Each round links all larger neighbours of an id to the smallest one around it, then all smaller ones; links become stars around the smallest
    ids in a number of rounds that grows with the logarithm of the longest path. Every link stays one row; nothing is gathered by key but minima.
    """
    now = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    seen = state(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("x"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("x")).select(F.col("b").alias("a"), F.col("m").alias("b"))   # b > a >= m
        large = large.distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("x"), "m")
        small = large.join(low, F.col("a") == F.col("x")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(low.select(F.col("x").alias("a"), F.col("m").alias("b")))
        after = written(small.distinct(), "links")
        discard(now)
        now, before = after, seen
        seen = state(now)
        if seen == before:
            break
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
