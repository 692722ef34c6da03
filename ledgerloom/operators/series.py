"""Prices by block: samples of prices and of block times on one time line."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _filled(both: DataFrame, columns: list[str]) -> DataFrame:
    """(ts, columns) with gaps filled from before. Days are filled on their own; what a day begins with comes from a small
    table of the last values of each day."""
    rows = both.withColumn("day", F.to_date("ts"))
    inside = Window.partitionBy("day").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    ends = rows.groupBy("day").agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ts"))).alias(f"__{c}") for c in columns))
    earlier = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select("day", *(F.last(f"__{c}", ignorenulls=True).over(earlier).alias(f"__{c}") for c in columns))
    return rows.join(starts, "day").select("ts", *(F.coalesce(F.last(c, ignorenulls=True).over(inside), F.col(f"__{c}")).alias(c) for c in columns))


def price_by_block(prices: DataFrame, blocks: DataFrame, dense: bool = True) -> DataFrame:
    """(block_num, price). prices (ts, price), blocks (ts, block_num) are samples. On the time line of both, each sample
    sees the last price and the last block; a block's price is the mean over what sees it, so samples until the next block
    count. dense: every block between the first and the last has a row, with the price of the last sampled one."""
    both = prices.select("ts", F.col("price").cast("double").alias("price"), F.lit(None).cast("long").alias("block_num")).unionByName(blocks.select("ts", F.lit(None).cast("double").alias("price"), F.col("block_num").cast("long").alias("block_num")))
    both = both.groupBy("ts").agg(F.max("price").alias("price"), F.max("block_num").alias("block_num"))
    known = _filled(both, ["price", "block_num"]).where("price is not null and block_num is not null")
    mean = known.groupBy("block_num").agg(F.avg("price").alias("price"))
    if not dense:
        return mean
    following = F.lead("block_num").over(Window.orderBy("block_num"))  # samples of blocks, thousands at most
    return mean.withColumn("next", F.coalesce(following - 1, F.col("block_num"))).select(F.explode(F.sequence("block_num", "next")).alias("block_num"), "price")
