"""Rules that say which nodes of a transaction have one owner, and the clusters that follow."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.encoding import ends_with_zeros, order_of
from .components import components


def _none() -> Column:
    return F.lit(None).cast("array<bigint>")


def _ids(side: str) -> Column:
    return F.array_distinct(F.transform(side, lambda x: x["node_id"]))


def _reused(x: Column, last: int) -> Column:
    """Whether a node was paid a second time, up to a block; 0 counts as never."""
    return (F.coalesce(x["reuse"], F.lit(0)) != 0) & (x["reuse"] <= last)


def common_inputs() -> Column:
    return _ids("ins")


def deposit(least: int = 25) -> Column:
    return F.when((F.size(_ids("ins")) >= least) & (F.size(_ids("outs")) <= 1), _ids("ins")).otherwise(_none())


def _one_in_two_out() -> Column:
    """One input, two outputs of two other nodes."""
    return (F.size("ins") == 1) & (F.size("outs") == 2) & (F.size(_ids("outs")) == 2) & ~F.arrays_overlap(_ids("ins"), _ids("outs"))


def change(last: int) -> Column:
    """Exactly one output's node is used again: the other one is change."""
    i, a, b = F.get("ins", 0), F.get("outs", 0), F.get("outs", 1)
    other = F.when(_reused(a, last) & ~_reused(b, last), b["node_id"]).when(_reused(b, last) & ~_reused(a, last), a["node_id"])
    return F.when(_one_in_two_out() & ~_reused(i, last) & other.isNotNull(), F.array(i["node_id"], other)).otherwise(_none())


def round_value(last: int, zeros: Column | int, j: int = 2) -> Column:
    """One output's value ends with so many zeros, the other's not even with j fewer: that one is change. zeros may be a
    column, as it depends on the block's price."""
    zeros = F.lit(zeros) if isinstance(zeros, int) else zeros
    i, a, b = F.get("ins", 0), F.get("outs", 0), F.get("outs", 1)
    fits = lambda x, y: ~_reused(x, last) & ends_with_zeros(y["value"], zeros) & ~ends_with_zeros(x["value"], zeros - j)
    other = F.when(fits(a, b), a["node_id"]).when(fits(b, a), b["node_id"])
    allowed = (zeros > j) & F.lit(j >= 0)
    return F.when(allowed & _one_in_two_out() & ~_reused(i, last) & other.isNotNull(), F.array(i["node_id"], other)).otherwise(_none())


def forced_merge(last: int) -> Column:
    """No input could be left out for the greater output: the smaller one (of equal ones the second) is change."""
    a, b = F.get("outs", 0), F.get("outs", 1)
    swap = a["value"] < b["value"]
    pay, rest = F.when(swap, b["value"]).otherwise(a["value"]), F.when(swap, a).otherwise(b)
    values = F.transform("ins", lambda x: x["value"])
    spare = F.aggregate(values, F.lit(0).cast("long"), lambda s, v: s + v) - F.array_min(values)
    shape = (F.size("ins") >= 2) & (F.size("outs") == 2) & (F.size(_ids("ins")) == F.size("ins")) & (F.size(_ids("outs")) == 2)
    return F.when(shape & ~F.exists("ins", lambda x: _reused(x, last)) & ~_reused(rest, last) & (spare < pay), F.concat(_ids("ins"), F.array(rest["node_id"]))).otherwise(_none())


def same_owner(transactions: DataFrame, rules: Sequence[Column]) -> DataFrame:
    """(block_num, position, rule, ids) of every rule that joins two nodes or more. transactions: of assemble()."""
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("rule"), c.alias("ids")) for k, c in enumerate(rules))))
    return transactions.select("block_num", "position", each.alias("r")).select("block_num", "position", "r.rule", "r.ids").where("size(ids) > 1")


def common_inputs_of(inputs: DataFrame) -> DataFrame:
    """(block_num, position, ids) of transactions whose inputs join two nodes or more, from inputs alone: the same sets as
    those of common_inputs(), without the outputs."""
    return inputs.groupBy("block_num", "position").agg(F.collect_set("node_id").alias("ids")).where("size(ids) > 1")


def star_edges(joined: DataFrame) -> DataFrame:
    """(a, b): from the first node of each set to the others."""
    return joined.select(F.col("ids")[0].alias("a"), F.explode("ids").alias("b")).where("a <> b")


def cluster(joined: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """(node_id, alias) of clusters of two nodes or more; alias is the least node. With clusters from before, they grow."""
    edges = star_edges(joined)
    if before is not None:
        edges = edges.unionByName(before.select(F.col("alias").alias("a"), F.col("node_id").alias("b")))
    return components(edges).select(F.col("id").alias("node_id"), F.col("component").alias("alias"))


def with_zeros(transactions: DataFrame, price: DataFrame, amount: float) -> DataFrame:
    """transactions with zeros: how many a round amount ends with at the block's price, null where that isn't known. price,
    one row for a block, is left to the planner: adaptive execution broadcasts it where it is small."""
    return transactions.join(price.select("block_num", "price"), "block_num", "left").withColumn("zeros", order_of(amount, F.col("price")).cast("int")).drop("price")
