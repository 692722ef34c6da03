"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import settle, unsettle


def _done(edges: DataFrame) -> bool:
    """Whether every u has one v, and no v is a u: then each component is a star around its least id."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("from"), F.lit(0).alias("to")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("from"), F.lit(1).alias("to")))
    return not ends.groupBy("x").agg(F.sum("from").alias("n"), F.max("to").alias("m")).where("n > 1 or (n = 1 and m = 1)").take(1)


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id of edges (a, b) that has another neighbour than itself: component is the least id that
    is reachable. Loops, repeated edges and either direction are fine; rows with a null end are left out.

    A round is two aggregates and two joins over what is left of the edges, and is written to the shared folder. The
    number of rounds grows with the logarithm of the longest path, not with the path."""
    now = settle(edges.where("a is not null and b is not null").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while not _done(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # tables, not plans, so that the joins can split the edges of a hub
        least = settle(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = settle(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = settle(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        after = settle(small.where("u <> v").distinct())
        unsettle(now, least, large, low)
        now = after
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
