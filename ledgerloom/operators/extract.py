"""From blocks to spent and created outputs, nodes and scripts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.encoding import txo_id
from ..functions.scripts import functions
from .merge import two_smallest

BROADCAST_BLOCKS = 2_000_000


def numbered(blocks: DataFrame, index: DataFrame, start: int = 0) -> DataFrame:
    """blocks with num of those that index (hash, num) has, from start on. The index is sent to all while it has no more
    than BROADCAST_BLOCKS rows (some 100 MB); a larger one is joined by shuffle."""
    small = index.where(F.col("num") >= start).select("hash", "num")
    return blocks.join(F.broadcast(small) if small.count() <= BROADCAST_BLOCKS else small, "hash")


def transactions(blocks: DataFrame) -> DataFrame:
    """(block_num, position, tx_hash, inputs, outputs); position 0 makes new coins."""
    return blocks.select(F.col("num").alias("block_num"), F.posexplode("transactions").alias("position", "t")).select("block_num", F.col("position").cast("long").alias("position"), "t.tx_hash", "t.inputs", "t.outputs")


def spent_txos(txs: DataFrame) -> DataFrame:
    rows = txs.where("position > 0").select("block_num", "position", F.explode("inputs").alias("i"))
    return rows.select("block_num", "position", txo_id(F.col("i.tx_hash"), F.col("i.vout")).alias("txo_id"))


def created_txos(txs: DataFrame) -> DataFrame:
    """(block_num, position, tp, value, txo_id, vout, hash): the owner's hash; outputs whose script is malformed are left out."""
    rows = txs.select("block_num", "position", "tx_hash", F.explode("outputs").alias("o"))
    out = rows.select("block_num", "position", "tx_hash", "o.vout", "o.value", functions()["match_owner"](F.col("o.script")).alias("w"))
    return out.where("w.owner is not null").select("block_num", "position", F.col("w.tp").alias("tp"), "value", txo_id(F.col("tx_hash"), F.col("vout")).alias("txo_id"), "vout", F.col("w.owner").alias("hash"))


def node_receipts(created: DataFrame) -> DataFrame:
    """(hash, reveal, reuse)."""
    return two_smallest(created, ["hash"], "block_num")


def scripts(txs: DataFrame) -> DataFrame:
    """(reveal, hash160, hash256, script) of scripts that inputs reveal: the first block of each."""
    rows = txs.where("position > 0").select("block_num", F.explode("inputs").alias("i"))
    f = functions()
    found = rows.select("block_num", f["hidden_script"](F.col("i.script"), F.col("i.witness")).alias("script")).where("script is not null")
    first = found.groupBy("script").agg(F.min("block_num").alias("reveal"))
    return first.select("reveal", f["hash160"](F.col("script")).alias("hash160"), F.unhex(F.sha2("script", 256)).alias("hash256"), "script")


def block_index(headers: DataFrame) -> DataFrame:
    """Rows of the blocks table of linked headers."""
    return headers.select("byte_start", "num", "num_file", "num_transactions", "hash")
