"""Detectors of coloured-coin transactions, over rows of raw transactions (inputs and outputs as arrays)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.encoding import order_tag
from ..functions.hashes import hash256
from ..functions.scripts import functions

#: Fixed value: where the class A and B transactions of the layer pay to.
EXODUS = "1EXoDusjGwvnjZUyKkxZ4UHEf77z6A5S4P"


def owner_of_address(address: str) -> bytes:
    """The 20 bytes of a Base58Check address."""
    from ..functions.address import BASE58

    n = 0
    for c in address:
        n = n * 58 + BASE58.index(c)
    raw = n.to_bytes(25, "big")
    if hash256(raw[:21])[:4] != raw[21:]:
        raise ValueError("bad checksum")
    return raw[1:21]


def _marked(tokens: Column) -> Column:
    """Whether the first token's first byte is that of a data carrier, be it an opcode or pushed data."""
    return F.startswith(F.hex(tokens[0]["data"]), F.lit("6A"))


def flags(transactions: DataFrame) -> DataFrame:
    """(block, position, oa, epobc, ol_ab, ol_c) of flagged transactions. transactions: (block_num, position, inputs,
    outputs) with zero-valued outputs; first transactions of blocks should have been left out.

    Scripts are tokenised once for all outputs, in one Arrow UDF each for tokens and owners."""
    f = functions()
    rows = transactions.select("block_num", "position", F.col("inputs")[0]["sequence"].alias("sequence"), F.posexplode_outer("outputs").alias("at", "o"))
    rows = rows.select("block_num", "position", "sequence", "at", f["parse_script"](F.col("o.script")).alias("t"), f["match_owner"](F.col("o.script")).alias("w"))
    some = F.size("t") > 0
    data = lambda text: F.hex(F.lit(text.encode()))
    later = F.filter(F.slice("t", 2, F.greatest(F.size("t"), F.lit(1))), lambda x: x["kind"] == "data")
    opens = F.when(some & _marked(F.col("t")), (F.size(later) > 0) & F.startswith(F.hex(F.get(later, 0)["data"]), data("OA")))
    layer = (F.size("t") > 1) & _marked(F.col("t")) & (F.get("t", 1)["kind"] == "data") & F.startswith(F.hex(F.get("t", 1)["data"]), data("omni"))
    paid = F.col("w.tp").isin(0, 1) & (F.hex("w.owner") == F.hex(F.lit(owner_of_address(EXODUS))))
    out = rows.groupBy(F.col("block_num").alias("block"), "position").agg(
        F.coalesce(F.min_by(opens.cast("int"), F.when(opens.isNotNull(), F.col("at"))), F.lit(0)).alias("oa"),  # the first carrier decides
        F.coalesce(F.max(order_tag(F.col("sequence")).cast("int")), F.lit(0)).alias("epobc"),
        F.coalesce(F.max(paid.cast("int")), F.lit(0)).alias("ol_ab"),
        F.coalesce(F.max(layer.cast("int")), F.lit(0)).alias("ol_c"),
    )
    return out.where(F.greatest("oa", "epobc", "ol_ab", "ol_c") > 0)
