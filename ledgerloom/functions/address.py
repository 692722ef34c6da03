"""Addresses of owners: Base58Check (BIP 13) and Bech32 (BIP 173)."""

from __future__ import annotations

from .hashes import hash256

BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
BASE32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"
GENERATOR = (0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)


def base58(data: bytes) -> str:
    n, out = int.from_bytes(data, "big"), ""
    while n:
        n, k = divmod(n, 58)
        out = BASE58[k] + out
    return BASE58[0] * (len(data) - len(data.lstrip(b"\0"))) + out


def base58check(version: int, data: bytes) -> str:
    body = bytes([version]) + data
    return base58(body + hash256(body)[:4])


def _checksum(values: list[int]) -> int:
    c = 1
    for v in values:
        top, c = c >> 25, (c & 0x1FFFFFF) << 5 ^ v
        for i, g in enumerate(GENERATOR):
            c ^= g if top >> i & 1 else 0
    return c


def bech32(prefix: str, version: int, data: bytes) -> str:
    """Address of a witness program of version 0."""
    bits = int.from_bytes(data, "big") << (-8 * len(data) % 5)
    n = -(-8 * len(data) // 5)
    values = [version, *(bits >> 5 * (n - 1 - i) & 31 for i in range(n))]
    head = [*(ord(c) >> 5 for c in prefix), 0, *(ord(c) & 31 for c in prefix)]
    check = _checksum([*head, *values, 0, 0, 0, 0, 0, 0]) ^ 1
    return prefix + "1" + "".join(BASE32[v] for v in [*values, *(check >> 5 * (5 - i) & 31 for i in range(6))])


def address(data: bytes, tp: int) -> str:
    """Of an owner's hash by its class: keys and key hashes, scripts and unknown ones, witness programs."""
    if tp in (0, 1):
        return base58check(0x00, data)
    if tp in (2, 6):
        return base58check(0x05, data)
    if tp in (3, 4):
        return bech32("bc", 0, data)
    raise ValueError(f"no address form for class {tp}")
