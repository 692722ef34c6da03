"""A ledger made of order tables: an order is a transaction, a line an output, and a line is spent by a later order.

Everything is integer arithmetic, so that SQL engines agree. Each frame reads only the columns that it needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EPOCH = "1995-01-01"


def _days(c: str) -> Column:
    return F.datediff(F.to_date(c), F.to_date(F.lit(EPOCH))).cast("long")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(order, block_num, position, priority): position counts the orders of a day by key."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderdate", "o_orderpriority")
    at = F.row_number().over(Window.partitionBy("o_orderdate").orderBy("o_orderkey")).cast("long") - 1
    return o.select(F.col("o_orderkey").alias("order"), _days("o_orderdate").alias("block_num"), at.alias("position"), F.col("o_orderpriority").alias("priority"))


def _lines(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", *columns)


def _identity() -> Column:
    return F.col("l_orderkey") * 16 + F.col("l_linenumber")


def created(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(block_num, position, txo_id, vout, node_id, value); identities may occur twice, as in old ledgers."""
    lines = _lines(spark, sf_dir, "l_quantity", "l_discount", "l_extendedprice")
    step = F.expr("cast(round(l_discount * 100) as int) div 4")
    small = F.when(step == 0, 10_000_000).when(step == 1, 20_000_000).otherwise(100_000)
    value = F.when(F.col("priority") == "5-LOW", small).otherwise(F.expr("cast(round(l_extendedprice * 100) as bigint)"))
    return lines.join(transactions(spark, sf_dir), lines.l_orderkey == F.col("order")).select(
        "block_num", "position", _identity().alias("txo_id"), (F.col("l_linenumber").cast("long") - 1).alias("vout"),
        (F.col("l_partkey") * 64 + F.col("l_quantity").cast("int")).alias("node_id"), value.cast("long").alias("value"),
    )


def spent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(block_num, position, txo_id), distinct."""
    lines = _lines(spark, sf_dir).withColumn("by", F.col("l_orderkey") + 1 + F.col("l_partkey") % 97)
    return lines.join(transactions(spark, sf_dir), F.col("by") == F.col("order")).select("block_num", "position", _identity().alias("txo_id")).distinct()
