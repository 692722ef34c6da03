"""Raw block files: a writer, a parser, and the scans of blocks, transactions and outputs.

Files are read through Spark (binaryFile), so they may be in any store that Spark knows; each becomes its blocks in one
pass of a Python generator on the executors. Padding after the last block is skipped."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashes import hash256
from ..functions.scripts import Malformed, Reader

INPUT = "struct<tx_hash:binary,vout:bigint,script:binary,witness:binary,sequence:bigint>"
OUTPUT = "struct<vout:bigint,value:bigint,script:binary>"
BLOCK = f"num_file int, byte_start bigint, byte_end bigint, hash binary, previous_hash binary, num_transactions int, transactions array<struct<tx_hash:binary,inputs:array<{INPUT}>,outputs:array<{OUTPUT}>>>"
HEADER = BLOCK.split(", transactions")[0]


def varint(n: int) -> bytes:
    return bytes([n]) if n < 0xFD else b"\xfd" + struct.pack("<H", n) if n < 1 << 16 else b"\xfe" + struct.pack("<I", n) if n < 1 << 32 else b"\xff" + struct.pack("<Q", n)


def parse_transaction(r: Reader, coinbase: bool, drop_zero: bool) -> dict:
    """Positions of outputs are those in the file, whichever are dropped. The hash leaves out marker, flag and witnesses."""
    version = r.take(4)
    body = r.at
    n = r.varint()
    witnessed = n == 0
    if witnessed:
        r.take(1)
        body = r.at
        n = r.varint()
    inputs = []
    for _ in range(n):
        tx_hash, vout = r.take(32), r.number(4)
        script = r.take(r.varint())
        inputs.append({"tx_hash": b"" if coinbase else tx_hash, "vout": -1 if coinbase else vout, "script": script, "witness": b"", "sequence": r.number(4)})
    outputs = []
    for vout in range(r.varint()):
        value = r.number(8)
        script = r.take(r.varint())
        if value or not drop_zero:
            outputs.append({"vout": vout, "value": value, "script": script})
    hashed = version + r.data[body : r.at]
    if witnessed:
        for x in inputs:
            start = r.at
            for _ in range(r.varint()):
                r.take(r.varint())
            x["witness"] = r.data[start : r.at]
    return {"tx_hash": hash256(hashed + r.take(4)), "inputs": inputs, "outputs": outputs}


def parse_block(r: Reader, drop_zero: bool = True) -> dict:
    start = r.at
    r.take(8)
    header = r.take(80)
    n = r.varint()
    transactions = [parse_transaction(r, i == 0, drop_zero) for i in range(n)]
    return {"byte_start": start, "byte_end": r.at, "hash": hash256(header), "previous_hash": header[4:36], "num_transactions": n, "transactions": transactions}


def parse_file(data: bytes, max_blocks: int | None = None, drop_zero: bool = True) -> Iterator[dict]:
    r, n = Reader(data), 0
    while r.at < len(data) and (max_blocks is None or n < max_blocks):
        if data[r.at : r.at + 4] == b"\0\0\0\0":  # padding
            return
        yield parse_block(r, drop_zero)
        n += 1


def file_name(number: int) -> str:
    return f"blk{number:05d}.dat"


def read_blocks(spark: SparkSession, folder: str, files: list[int] | None = None, max_blocks: int | None = None, drop_zero: bool = True, headers_only: bool = False) -> DataFrame:
    """One row for each block. files: numbers of those to read, so that others aren't opened. max_blocks: of each file."""
    source = spark.read.format("binaryFile")
    if files is not None:
        found = source.load([f"{folder}/{file_name(n)}" for n in files])
    else:
        found = source.option("pathGlobFilter", "blk*.dat").load(folder)
    found = found.select(F.regexp_extract("path", r"blk(\d+)\.dat$", 1).cast("int").alias("num_file"), "content")
    schema = HEADER if headers_only else BLOCK

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for number, content in zip(batch["num_file"], batch["content"], strict=True):
                rows = []
                for block in parse_file(bytes(content), max_blocks, drop_zero):
                    if headers_only:
                        del block["transactions"]
                    rows.append({"num_file": number, **block})
                    if len(rows) == 64:
                        yield pd.DataFrame(rows)
                        rows = []
                if rows:
                    yield pd.DataFrame(rows)

    return found.mapInPandas(run, schema)


def write_transaction(inputs: list[tuple], outputs: list[tuple], version: int = 1, locktime: int = 0) -> bytes:
    """inputs: (tx_hash, vout, script, sequence, items of the witness or none); outputs: (value, script)."""
    body = varint(len(inputs)) + b"".join(h + struct.pack("<I", v & 0xFFFFFFFF) + varint(len(s)) + s + struct.pack("<I", q) for h, v, s, q, _ in inputs)
    body += varint(len(outputs)) + b"".join(struct.pack("<Q", v) + varint(len(s)) + s for v, s in outputs)
    witnesses = b"".join(varint(len(w)) + b"".join(varint(len(x)) + x for x in w) for *_, w in inputs)
    marked = any(w for *_, w in inputs)
    return struct.pack("<i", version) + (b"\0\1" if marked else b"") + body + (witnesses if marked else b"") + struct.pack("<I", locktime)


def write_block(previous_hash: bytes, transactions: list[bytes], nonce: int = 0) -> tuple[bytes, bytes]:
    """The block's bytes with magic and size, and its hash. Root and time are not meant to be valid."""
    header = struct.pack("<i", 1) + previous_hash + bytes(32) + struct.pack("<III", 0, 0, nonce)
    body = header + varint(len(transactions)) + b"".join(transactions)
    return b"\xf9\xbe\xb4\xd9" + struct.pack("<I", len(body)) + body, hash256(header)


__all__ = ["BLOCK", "Malformed", "file_name", "parse_file", "read_blocks", "varint", "write_block", "write_transaction"]
