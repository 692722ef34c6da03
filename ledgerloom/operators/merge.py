"""Upserts as joins and aggregates: associative merges, so that batches in any order give what one run gives."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def insert_ignore(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """old, and the rows of new whose keys it has not; of new rows with one key the first by order, or by all columns."""
    by = [*order, *(c for c in new.columns if c not in order and c not in keys)] or list(keys)
    one = new.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where("__n = 1").drop("__n")
    return old.unionByName(one.join(old.select(*keys), list(keys), "left_anti"))


def merge_edges(*parts: DataFrame) -> DataFrame:
    """Directed edges of several batches as one table."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("a", "b").agg(F.min("reveal").alias("reveal"), F.max("last_seen").alias("last_seen"), F.sum("total").alias("total"), F.min("min_sent").alias("min_sent"), F.max("max_sent").alias("max_sent"), F.sum("total_sent").alias("total_sent"))


def merge_undirected(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("a", "b").agg(F.min("reveal").alias("reveal"))


def two_smallest(rows: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """(keys, reveal, reuse): the least value and the second least, counting repeats; reuse is null where there is one
    value. At most two rows of a key get past the ranking, which happens before the shuffle as well as after."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(column))
    best = rows.select(*keys, column).withColumn("__n", rank).where("__n <= 2")
    return best.groupBy(*keys).agg(F.min(column).alias("reveal"), F.max(F.when(F.col("__n") == 2, F.col(column))).alias("reuse"))


def merge_nodes(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tables of (keys, reveal, reuse) as one: the two least of all values that either knows."""
    both = old.select(*keys, "reveal", "reuse").unionByName(new.select(*keys, "reveal", "reuse"))
    return two_smallest(both.select(*keys, F.explode(F.array("reveal", "reuse")).alias("block")).where("block is not null"), keys, "block")


def merge_scripts(*parts: DataFrame) -> DataFrame:
    """Script tables as one: the first block of each hash."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("hash160").agg(F.min("reveal").alias("reveal"), F.min("hash256").alias("hash256"), F.min("script").alias("script"))


def with_ids(old: DataFrame, hashes: DataFrame, key: str = "hash", name: str = "node_id") -> DataFrame:
    """(key, name): the ids that old has, and new ones after its greatest for the hashes that are new, by their order.
    Ids don't depend on partitions: ranks are local to ranges of hashes, and ranges are counted before."""
    fresh = hashes.select(key).where(F.col(key).isNotNull()).distinct().join(old.select(key), key, "left_anti")
    top = old.agg(F.max(name)).first()[0]
    part = F.conv(F.substring(F.hex(F.col(key)), 1, 3), 16, 10).cast("int")
    fresh = fresh.withColumn("__p", F.coalesce(part, F.lit(0)))
    before = fresh.groupBy("__p").agg(F.count(F.lit(1)).alias("__c"))
    before = before.withColumn("__o", F.coalesce(F.sum("__c").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__c")
    rank = F.row_number().over(Window.partitionBy("__p").orderBy(key))
    start = 0 if top is None else top + 1
    made = fresh.withColumn("__r", rank).join(before, "__p").select(key, (F.col("__r") - 1 + F.col("__o") + start).cast("long").alias(name))
    return old.select(key, name).unionByName(made)


def upsert(old: DataFrame, new: DataFrame, key: str, columns: Sequence[str] | None = None) -> DataFrame:
    """old with the named columns (those of new, if none are) taken from new where it has the key; other columns stay."""
    names = [c for c in (columns or new.columns) if c != key]
    right = new.select(F.col(key).alias("__k"), F.lit(1).alias("__in"), *(F.col(c).alias(f"__{c}") for c in names))
    both = old.join(right, F.col(key) == F.col("__k"), "full_outer")
    fresh = [F.when(F.col("__in") == 1, F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in names else F.col(c) for c in old.columns if c != key]
    added = [F.col(f"__{c}").alias(c) for c in names if c not in old.columns]
    return both.select(F.coalesce(F.col(key), F.col("__k")).alias(key), *fresh, *added)


def update_where(df: DataFrame, where: Column, **values: Any) -> DataFrame:
    """Columns set to constants where a condition is true."""
    hit = F.coalesce(where, F.lit(False))
    return df.withColumns({c: F.when(hit, F.lit(v)).otherwise(F.col(c)).cast(df.schema[c].dataType) for c, v in values.items()})


def delete_where(df: DataFrame, where: Column) -> DataFrame:
    """Rows for which a condition isn't true."""
    return df.where(~F.coalesce(where, F.lit(False)))
