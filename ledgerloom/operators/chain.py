"""The chain of blocks: heights by pointer doubling, and the branch that is longest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import settle, unsettle


def link_chain(headers: DataFrame, start: int = 0) -> DataFrame:
    """headers with num: the height of each block of the longest branch, others left out (of branches of one length that of
    the least tip hash stays). headers has hash and previous_hash; a block whose predecessor isn't there begins at start.

    Jumps double each round, so a chain of n blocks takes log2(n) rounds of one join, and no block is walked one by one."""
    known = headers.select("hash").distinct()
    base = headers.dropDuplicates(["hash"])
    jump = settle(base.join(known.select(F.col("hash").alias("previous_hash")), "previous_hash", "left_semi").select(F.col("hash").alias("x"), F.col("previous_hash").alias("y"), F.lit(1).cast("long").alias("n")))
    jumps = [jump]
    while True:
        ahead = jumps[-1].select(F.col("x").alias("y"), F.col("y").alias("z"), F.col("n").alias("m"))
        step = settle(jumps[-1].join(ahead, "y").select("x", F.col("z").alias("y"), (F.col("n") + F.col("m")).alias("n")))
        if not step.take(1):
            break
        jumps.append(step)
    # heights: greedily the longest jumps first
    height = settle(base.select(F.col("hash").alias("x"), F.col("hash").alias("at"), F.lit(0).cast("long").alias("h")))
    for step in reversed(jumps):
        moved = step.select(F.col("x").alias("at"), F.col("y").alias("to"), "n")
        after = settle(height.join(moved, "at", "left").select("x", F.coalesce("to", "at").alias("at"), (F.col("h") + F.coalesce("n", F.lit(0))).alias("h")))
        unsettle(height)
        height = after
    tip = height.orderBy(F.desc("h"), "x").limit(1)
    main = tip.select(F.col("x").alias("hash"))
    for step in jumps:
        main = settle(main.unionByName(main.join(step.select(F.col("x").alias("hash"), "y"), "hash").select(F.col("y").alias("hash"))).distinct())
    unsettle(*jumps)
    return base.join(main, "hash", "left_semi").join(height.select(F.col("x").alias("hash"), (F.col("h") + start).alias("num")), "hash")
