"""RIPEMD-160, from hashlib where it is there, else in Python, and what builds on it."""

from __future__ import annotations

import hashlib
import struct

#: Fixed values of RIPEMD-160: word order and shifts of both lines, additive constants.
LEFT = (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 7, 4, 13, 1, 10, 6, 15, 3, 12, 0, 9, 5, 2, 14, 11, 8, 3, 10, 14, 4, 9, 15, 8, 1, 2, 7, 0, 6, 13, 11, 5, 12, 1, 9, 11, 10, 0, 8, 12, 4, 13, 3, 7, 15, 14, 5, 6, 2, 4, 0, 5, 9, 7, 12, 2, 10, 14, 1, 3, 8, 11, 6, 15, 13)
RIGHT = (5, 14, 7, 0, 9, 2, 11, 4, 13, 6, 15, 8, 1, 10, 3, 12, 6, 11, 3, 7, 0, 13, 5, 10, 14, 15, 8, 12, 4, 9, 1, 2, 15, 5, 1, 3, 7, 14, 6, 9, 11, 8, 12, 2, 10, 0, 4, 13, 8, 6, 4, 1, 3, 11, 15, 0, 5, 12, 2, 13, 9, 7, 10, 14, 12, 15, 10, 4, 1, 5, 8, 7, 6, 2, 13, 14, 0, 3, 9, 11)
LEFT_SHIFT = (11, 14, 15, 12, 5, 8, 7, 9, 11, 13, 14, 15, 6, 7, 9, 8, 7, 6, 8, 13, 11, 9, 7, 15, 7, 12, 15, 9, 11, 7, 13, 12, 11, 13, 6, 7, 14, 9, 13, 15, 14, 8, 13, 6, 5, 12, 7, 5, 11, 12, 14, 15, 14, 15, 9, 8, 9, 14, 5, 6, 8, 6, 5, 12, 9, 15, 5, 11, 6, 8, 13, 12, 5, 12, 13, 14, 11, 8, 5, 6)
RIGHT_SHIFT = (8, 9, 9, 11, 13, 15, 15, 5, 7, 7, 8, 11, 14, 14, 12, 6, 9, 13, 15, 7, 12, 8, 9, 11, 7, 7, 12, 7, 6, 15, 13, 11, 9, 7, 15, 11, 8, 6, 6, 14, 12, 13, 5, 14, 13, 13, 7, 5, 15, 5, 8, 11, 14, 14, 6, 14, 6, 9, 12, 9, 12, 5, 15, 8, 8, 5, 12, 9, 12, 5, 14, 6, 8, 13, 6, 5, 15, 13, 11, 11)
LEFT_ADD = (0x00000000, 0x5A827999, 0x6ED9EBA1, 0x8F1BBCDC, 0xA953FD4E)
RIGHT_ADD = (0x50A28BE6, 0x5C4DD124, 0x6D703EF3, 0x7A6D76E9, 0x00000000)
START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476, 0xC3D2E1F0)
M = 0xFFFFFFFF
MIX = (
    lambda x, y, z: x ^ y ^ z,
    lambda x, y, z: (x & y) | (~x & z),
    lambda x, y, z: (x | ~y) ^ z,
    lambda x, y, z: (x & z) | (y & ~z),
    lambda x, y, z: x ^ (y | ~z),
)


def _roll(x: int, n: int) -> int:
    return ((x << n) | (x >> (32 - n))) & M


def ripemd160_python(data: bytes) -> bytes:
    state = START
    padded = data + b"\x80" + b"\0" * ((55 - len(data)) % 64) + struct.pack("<Q", 8 * len(data))
    for at in range(0, len(padded), 64):
        words = struct.unpack_from("<16I", padded, at)
        lines = []
        for order, shift, add, flip in ((LEFT, LEFT_SHIFT, LEFT_ADD, False), (RIGHT, RIGHT_SHIFT, RIGHT_ADD, True)):
            a, b, c, d, e = state
            for i in range(80):
                k = i // 16
                t = (a + MIX[4 - k if flip else k](b, c, d) + words[order[i]] + add[k]) & M
                a, e, d, c, b = e, d, _roll(c, 10), b, (_roll(t, shift[i]) + e) & M
            lines.append((a, b, c, d, e))
        x, y = lines
        state = tuple((state[(i + 1) % 5] + x[(i + 2) % 5] + y[(i + 3) % 5]) & M for i in range(5))
    return struct.pack("<5I", *state)


def ripemd160(data: bytes) -> bytes:
    try:
        return hashlib.new("ripemd160", data).digest()
    except ValueError:
        return ripemd160_python(data)


def sha256(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()


def hash160(data: bytes) -> bytes:
    return ripemd160(sha256(data))


def hash256(data: bytes) -> bytes:
    return sha256(sha256(data))
