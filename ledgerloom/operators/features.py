"""Features of clusters, each one aggregate, and their assembly into one row a cluster."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import TABLES
from .components import components
from .scan import after

COLUMNS = TABLES["node_features"].names


def cluster_size(nodes: DataFrame, alias: DataFrame, start: int = 0, end: int | None = None) -> DataFrame:
    """Nodes of each cluster that appeared after start, up to end; a node without a cluster is its own."""
    seen = nodes.where(F.col("reveal") > start) if end is None else nodes.where(after(start, end, "reveal"))
    return seen.join(alias, "node_id", "left").groupBy(F.coalesce("alias", "node_id").alias("alias")).agg(F.count(F.lit(1)).alias("cluster_size"))


def degree(undirected: DataFrame) -> DataFrame:
    return undirected.select(F.explode(F.array("a", "b")).alias("alias")).groupBy("alias").agg(F.count(F.lit(1)).alias("degree"))


def _flows(edges: DataFrame, key: str, way: str, verb: str) -> DataFrame:
    return edges.groupBy(F.col(key).alias("alias")).agg(
        F.count(F.lit(1)).alias(f"degree_{way}"), F.sum("total").alias(f"total_transactions_{way}"), F.min("reveal").alias(f"first_transaction_{way}"),
        F.max("last_seen").alias(f"last_transaction_{way}"), F.min("min_sent").alias(f"min_{verb}"), F.max("max_sent").alias(f"max_{verb}"), F.sum("total_sent").alias(f"total_{verb}"),
    )


def in_features(edges: DataFrame) -> DataFrame:
    return _flows(edges, "b", "in", "received")


def out_features(edges: DataFrame) -> DataFrame:
    return _flows(edges, "a", "out", "sent")


def cluster_num_edges(inner: DataFrame) -> DataFrame:
    return inner.groupBy("alias").agg(F.count(F.lit(1)).alias("cluster_num_edges"))


def cluster_num_cc(inner: DataFrame, sizes: list[int] | None = None) -> DataFrame:
    """(alias, cluster_num_cc, cluster_num_nodes_in_cc): components and nodes of the graph inside each cluster. With sizes
    only clusters with so many edges are looked at. A cluster of one edge is one component of two nodes without a search."""
    count = inner.groupBy("alias").agg(F.count(F.lit(1)).alias("n"))
    if sizes is not None:
        count = count.where(F.col("n").isin(sizes))
    single = count.where("n = 1").select("alias", F.lit(1).cast("long").alias("cluster_num_cc"), F.lit(2).cast("long").alias("cluster_num_nodes_in_cc"))
    rest = inner.join(count.where("n > 1").select("alias"), "alias")
    of = rest.select("alias", F.explode(F.array("a", "b")).alias("id")).distinct()
    several = of.join(components(rest), "id").groupBy("alias").agg(F.count_distinct("component").alias("cluster_num_cc"), F.count(F.lit(1)).alias("cluster_num_nodes_in_cc"))
    return single.unionByName(several)


def assemble(*parts: DataFrame) -> DataFrame:
    """One row for each alias of any part, columns of the feature table, null where no part has them. Parts are stacked and
    grouped once; no chain of outer joins."""
    have = [set(p.columns) for p in parts]
    wide = [p.select("alias", *((F.col(c) if c in h else F.lit(None)).cast(TABLES["node_features"][c].dataType).alias(c) for c in COLUMNS[1:])) for p, h in zip(parts, have, strict=True)]
    return reduce(DataFrame.unionByName, wide).groupBy("alias").agg(*(F.max(c).alias(c) for c in COLUMNS[1:]))
