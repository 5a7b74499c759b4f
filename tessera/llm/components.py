"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stash


def _stars(now: DataFrame) -> bool:
    """Every u has one v, and no v is a u."""
    ends = now.select(F.col("u").alias("id"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(now.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("id").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 or out = 1 and into = 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id in ``edges`` (columns a, b: long, not null); component is its least id.

    Each round contracts every neighbourhood on to its least member, so rounds grow with the
    logarithm of the longest chain.  A hub's edges are first reduced by a partial minimum and
    then joined with that one row, which AQE splits.  Every round is written to the shared
    folder.  An empty input gives an empty result.
    """
    now = stash(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while not _stars(now):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stash(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stash(large.where("u != v").distinct())
        near = large.join(stash(large.groupBy("u").agg(F.min("v").alias("m"))), "u")
        small = near.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(near.select("u", F.col("m").alias("v")))
        now = stash(small.where("u != v").distinct())
    stars = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return stash(stars.union(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()))
