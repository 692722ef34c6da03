"""Inputs and outputs of transactions. An input names an output by identity; the as-of join finds the latest creation of
that identity that is not after the spending block."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TX = ["block_num", "position"]


def exclude(rows: DataFrame, *flagged: DataFrame) -> DataFrame:
    """rows of transactions that none of the tables (block, position) flags."""
    for f in flagged:
        rows = rows.join(f.select(F.col("block").alias("block_num"), "position").distinct(), TX, "left_anti")
    return rows


def only(rows: DataFrame, positions: Sequence[int] | None) -> DataFrame:
    return rows if positions is None else rows.where(F.col("position").isin(list(positions)) if positions else F.lit(False))


def _checked(excluded: Sequence[DataFrame], positions: Sequence[int] | None) -> None:
    if excluded and positions is not None:
        raise ValueError("positions are either named or excluded")


def join_nodes(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """rows with what nodes knows of their node_id; rows of unknown nodes go."""
    return rows.join(nodes, "node_id")


def join_alias(rows: DataFrame, alias: DataFrame) -> DataFrame:
    """rows with alias: their cluster, or the node itself where it has none."""
    return rows.join(alias, "node_id", "left").withColumn("alias", F.coalesce("alias", "node_id"))


def one_per_transaction(spent: DataFrame) -> DataFrame:
    """Of each transaction the spent output of the least identity."""
    return spent.groupBy(*TX).agg(F.min("txo_id").alias("txo_id"))


def resolve_inputs(
    spent: DataFrame, created: DataFrame, excluded: Sequence[DataFrame] = (), one_per_tx: bool = False, only_positions: Sequence[int] | None = None,
    nodes: DataFrame | None = None, alias: DataFrame | None = None,
) -> DataFrame:
    """(block_num, position, txo_id, vout, node_id, value) of spent outputs; those without a creation in time go.

    Exclusions and the choice of one output come first, so the join sees fewer rows. The latest creation is taken by a
    hash aggregate on (spending transaction, identity), whose ties are broken by the least node and value."""
    _checked(excluded, only_positions)
    rows = only(exclude(spent.select(*TX, "txo_id"), *excluded), only_positions)
    rows = one_per_transaction(rows) if one_per_tx else rows.distinct()
    made = created.select("txo_id", F.col("block_num").alias("made"), "vout", "node_id", "value")
    order = F.struct(F.col("made"), -F.col("node_id"), -F.col("value"))
    found = rows.join(made, "txo_id").where("made <= block_num")
    best = found.groupBy(*TX, "txo_id").agg(F.max_by(F.struct("vout", "node_id", "value"), order).alias("o"))
    out = best.select(*TX, "txo_id", "o.vout", "o.node_id", "o.value")
    out = join_nodes(out, nodes) if nodes is not None else out
    return join_alias(out, alias) if alias is not None else out


def resolve_outputs(
    created: DataFrame, excluded: Sequence[DataFrame] = (), only_positions: Sequence[int] | None = None, nodes: DataFrame | None = None, alias: DataFrame | None = None
) -> DataFrame:
    """(block_num, position, txo_id, vout, node_id, value), each identity of a transaction once: the least node and value."""
    _checked(excluded, only_positions)
    rows = only(exclude(created.select(*TX, "txo_id", "vout", "node_id", "value"), *excluded), only_positions)
    out = rows.groupBy(*TX, "txo_id").agg(F.min(F.struct("node_id", "value", "vout")).alias("o")).select(*TX, "txo_id", "o.vout", "o.node_id", "o.value")
    out = join_nodes(out, nodes) if nodes is not None else out
    return join_alias(out, alias) if alias is not None else out


def resolve_inputs_ranked(spent: DataFrame, created: DataFrame) -> DataFrame:
    """The same rows by a ranking window over each spending transaction and identity, for inputs that are sorted already."""
    made = created.select("txo_id", F.col("block_num").alias("made"), "vout", "node_id", "value")
    rank = F.row_number().over(Window.partitionBy(*TX, "txo_id").orderBy(F.desc("made"), "node_id", "value"))
    return spent.select(*TX, "txo_id").distinct().join(made, "txo_id").where("made <= block_num").withColumn("n", rank).where("n = 1").drop("n", "made")


def node_table(created: DataFrame) -> DataFrame:
    """(node_id, reveal, reuse): the blocks of a node's first two receipts."""
    from .merge import two_smallest

    return two_smallest(created, ["node_id"], "block_num")
