"""JSON inputs: times of blocks and market prices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIRST_DAY = "2012-01-01"


def read_block_dates(spark: SparkSession, path: str) -> DataFrame:
    """(ts, block_num) of an object that maps heights to seconds."""
    text = spark.read.text(path, wholetext=True)
    pairs = text.select(F.explode(F.from_json("value", "map<string,bigint>")).alias("k", "v"))
    return pairs.select(F.timestamp_seconds("v").alias("ts"), F.col("k").cast("long").alias("block_num"))


def read_market_price(spark: SparkSession, path: str, name: str = "market-price", first_day: str = FIRST_DAY) -> DataFrame:
    """(ts, price) of an object with a list of {x: milliseconds, y: price}; prices of nothing and early ones are left out.
    Milliseconds are cut to seconds."""
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.explode(F.from_json("value", f"struct<`{name}`:array<struct<x:bigint,y:double>>>")[name]).alias("p"))
    out = rows.select(F.timestamp_seconds(F.expr("p.x div 1000")).alias("ts"), F.col("p.y").alias("price"))
    return out.where((F.col("price") > 0) & (F.col("ts") >= F.lit(first_day).cast("timestamp")))
