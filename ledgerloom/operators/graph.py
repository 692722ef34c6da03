"""Graphs of clusters: who paid whom, directed and undirected, and the edges inside a cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .resolve import TX


def payments(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """(block_num, position, a, b, value): what each transaction's sender paid to each other cluster, sums above zero.
    inputs has one row for a transaction; both sides have alias."""
    sums = outputs.groupBy(*TX, F.col("alias").alias("b")).agg(F.sum("value").alias("value"))
    return inputs.select(*TX, F.col("alias").alias("a")).join(sums, TX).where("a <> b and value > 0")


def transaction_edges(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Directed edges: first and last block, payments, their least, greatest and total value."""
    return payments(inputs, outputs).groupBy("a", "b").agg(
        F.min("block_num").alias("reveal"), F.max("block_num").alias("last_seen"), F.count(F.lit(1)).alias("total"),
        F.min("value").alias("min_sent"), F.max("value").alias("max_sent"), F.sum("value").alias("total_sent"),
    )


def undirected_edges(edges: DataFrame) -> DataFrame:
    """Pairs a < b and the first block of either direction."""
    return edges.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("reveal").alias("reveal"))


def cluster_edges(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """(a, b, alias): input nodes to output nodes of one transaction, within the cluster of its input of the least identity,
    but not to nodes that are inputs of that cluster too. An output's cluster is that of its node, as is an input's."""
    first = inputs.groupBy(*TX).agg(F.min_by("alias", F.struct("txo_id", "node_id")).alias("alias"))
    senders = inputs.join(first, [*TX, "alias"]).select(*TX, "alias", F.col("node_id").alias("a")).distinct()
    receivers = outputs.select(*TX, "alias", F.col("node_id").alias("b")).distinct()
    fresh = receivers.join(senders.select(*TX, "alias", F.col("a").alias("b")), [*TX, "alias", "b"], "left_anti")
    return senders.join(fresh, [*TX, "alias"]).groupBy("a", "b").agg(F.min("alias").alias("alias"))
