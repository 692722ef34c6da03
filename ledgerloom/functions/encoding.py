"""Encodings of a ledger as column expressions: no Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def reversed_hex(data: Column, width: int) -> Column:
    """Lower-case hex of the bytes of data, which has width of them, last byte first. (reverse() of a binary would turn it
    into a string first.)"""
    h = F.hex(data)
    return F.lower(F.concat(*(F.substring(h, 2 * i - 1, 2) for i in range(width, 0, -1))))


def little_endian(data: Column, width: int = 8) -> Column:
    """The unsigned number of width bytes, as a long."""
    return F.conv(reversed_hex(data, width), 16, 10).cast("long")


def big_endian(data: Column) -> Column:
    return F.conv(F.hex(data), 16, 10).cast("long")


def sha256(data: Column) -> Column:
    return F.unhex(F.sha2(data, 256))


def hash256(data: Column) -> Column:
    """Double SHA-256."""
    return sha256(sha256(data))


def txo_id(tx_hash: Column, vout: Column) -> Column:
    """32 bytes of the transaction's hash, then the output's position in 4 bytes, big-endian."""
    return F.concat(tx_hash, F.unhex(F.lpad(F.hex(vout.cast("long")), 8, "0")))


def txo_vout(identity: Column) -> Column:
    return big_endian(F.substring(identity, 33, 4))


def txo_hash_hex(identity: Column) -> Column:
    """The transaction's hash as it is displayed."""
    return reversed_hex(F.substring(identity, 1, 32), 32)


def ends_with_zeros(value: Column, zeros: Column | int) -> Column:
    """Whether the decimal form of value ends with so many zeros."""
    zeros = F.lit(zeros) if isinstance(zeros, int) else zeros
    return F.endswith(value.cast("string"), F.repeat(F.lit("0"), zeros))


def order_of(amount: float, price: Column) -> Column:
    """Floor of the decimal logarithm of what amount of currency is worth in the smallest unit, at price per 10**8 of them.
    It is a quotient of natural logarithms, so that exact powers fall as they do there."""
    return F.floor(F.log(F.lit(float(amount)) / (price / F.lit(1e8))) / F.log(F.lit(10.0)))


def order_tag(sequence: Column) -> Column:
    """Whether a 32-bit sequence number carries an order-based colouring tag: its low six bits are 0x25 or 0x33."""
    return sequence.bitwiseAND(63).isin(0x25, 0x33)


#: Canonical locking scripts as hex: a class, its pattern, where the owner's hex begins and how long it is.
PUSH = {n: f"(?:{n:02X}|4C{n:02X}|4D{n:02X}00|4E{n:02X}000000)" for n in (20, 32, 33, 65)}
PATTERNS = (
    (0, f"^(?:{PUSH[65]}04[0-9A-F]{{128}}|{PUSH[33]}0[23][0-9A-F]{{64}})AC$"),
    (1, f"^76A9{PUSH[20]}[0-9A-F]{{40}}88AC$"),
    (2, f"^A9{PUSH[20]}[0-9A-F]{{40}}87$"),
)


def canonical_class(script: Column) -> Column:
    """0 (key), 1 (key hash), 2 (script hash), 3 and 4 (witness programs of 20 and 32 bytes) of scripts in usual forms; null for
    others, which functions.scripts classifies token by token. A witness program may follow any single opcode."""
    h = F.hex(script)
    out = F.lit(None).cast("int")
    out = F.when(h.rlike(f"^(?:00|4F|[5-9A-F][0-9A-F]){PUSH[32]}[0-9A-F]{{64}}$"), 4).otherwise(out)
    out = F.when(h.rlike(f"^(?:00|4F|[5-9A-F][0-9A-F]){PUSH[20]}[0-9A-F]{{40}}$"), 3).otherwise(out)
    for number, pattern in reversed(PATTERNS):
        out = F.when(h.rlike(pattern), number).otherwise(out)
    return out


SIGNATURE = "^30[0-9a-f]{2}[0-9a-f]+02[0-9a-f]+(01|02|03|81|82|83)$"


def is_signature(data: Column) -> Column:
    """Whether bytes look like a DER signature with its hash type."""
    return F.lower(F.hex(data)).rlike(SIGNATURE)


def is_public_key(data: Column) -> Column:
    h, n = F.hex(data), F.octet_length(data)
    return ((n == 65) & h.startswith("04")) | ((n == 33) & (h.startswith("02") | h.startswith("03")))
