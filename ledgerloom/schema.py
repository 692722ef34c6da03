"""Tables of a ledger. Identities are longs here where a stored ledger has byte strings: operators take either."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(ddl: str) -> T.StructType:
    kinds = {"int": T.IntegerType(), "long": T.LongType(), "binary": T.BinaryType(), "string": T.StringType()}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (x.split() for x in ddl.split(", "))])


TABLES = {
    "blocks": _struct("byte_start long, num long, num_file int, num_transactions int, hash binary"),
    "spent_txos": _struct("block_num long, position long, txo_id binary"),
    "created_txos": _struct("block_num long, position long, tp int, value long, txo_id binary, node_id long"),
    "nodes": _struct("node_id long, reveal long, reuse long, hash binary"),
    "scripts": _struct("reveal long, hash160 binary, hash256 binary, script binary"),
    "coinjoin": _struct("block long, position long, joinmarket int, wasabi1 int, wasabi11 int, wasabi2 int, whirlpool int, whirlpool_tx0 int"),
    "colored_coin": _struct("block long, position long, oa int, epobc int, ol_ab int, ol_c int"),
    "alias": _struct("node_id long, alias long"),
    "transaction_edges": _struct("a long, b long, reveal long, last_seen long, total long, min_sent long, max_sent long, total_sent long"),
    "undirected_transaction_edges": _struct("a long, b long, reveal long"),
    "cluster_transaction_edges": _struct("a long, b long, alias long"),
    "node_features": _struct(
        "alias long, degree long, degree_in long, degree_out long, total_transactions_in long, total_transactions_out long, first_transaction_in long, last_transaction_in long, "
        "first_transaction_out long, last_transaction_out long, min_sent long, max_sent long, total_sent long, min_received long, max_received long, total_received long, "
        "cluster_size long, cluster_num_edges long, cluster_num_cc long, cluster_num_nodes_in_cc long, label string"
    ),
}
#: Column that says how far a table has come, where it has one.
PROGRESS = {"blocks": "num", "spent_txos": "block_num", "created_txos": "block_num", "nodes": "reveal", "scripts": "reveal", "transaction_edges": "reveal", "undirected_transaction_edges": "reveal", "coinjoin": "block", "colored_coin": "block"}
