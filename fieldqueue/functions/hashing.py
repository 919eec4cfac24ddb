"""Keyed hashes built from Catalyst expressions, and the digests of many numbered texts at once."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def hmac_sha256(key: bytes, text: Column) -> Column:
    """Lower-case hex of HMAC-SHA256 of a string column."""
    if len(key) > 64:
        raise ValueError("a key of at most 64 bytes is expected")
    block = key.ljust(64, b"\0")
    inner = F.lit(bytearray(b ^ 0x36 for b in block))
    outer = F.lit(bytearray(b ^ 0x5C for b in block))
    digest = F.sha2(F.concat(inner, F.encode(text, "UTF-8")), 256)
    return F.sha2(F.concat(outer, F.unhex(digest)), 256)


def keyed_bucket(key: bytes, text: Column, n: int) -> Column:
    """First eight bytes of the keyed digest, big endian and unsigned, modulo n."""
    head = F.conv(F.substring(hmac_sha256(key, text), 1, 16), 16, 10).cast("decimal(20,0)")
    return (head % F.lit(n).cast("decimal(20,0)")).cast("int")


# fixed values of MD5: its start, the constants and rotations of its 64 steps, and the word that each reads
MD5_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
MD5_ADD = np.floor(np.abs(np.sin(np.arange(1, 65))) * 2.0**32).astype(np.uint32)
MD5_TURN = [t[i % 4] for t in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for i in range(16)]
MD5_WORD = [g for m, a in ((1, 0), (5, 1), (3, 5), (7, 0)) for g in [(m * i + a) % 16 for i in range(16)]]


def numbered(prefix: bytes, numbers: np.ndarray) -> tuple[bytes, np.ndarray, list[np.ndarray | None]]:
    """What md5_heads() reads of a prefix and whole numbers of equally many digits: the digits, and what they add to each word of a text's block."""
    digits = np.array([str(n).encode() for n in numbers.tolist()])
    long, out = digits.dtype.itemsize, np.zeros((len(digits), 64), np.uint8)
    if len(prefix) + long < 56:
        out[:, len(prefix) : len(prefix) + long] = digits.view(np.uint8).reshape(-1, long)
    return prefix, digits, [w if w.any() else None for w in np.ascontiguousarray(out.view("<u4").T)]


def md5_heads(numbers: tuple[bytes, np.ndarray, list[np.ndarray | None]], suffixes: list[bytes]) -> np.ndarray:
    """First 60 bits of the MD5 of prefix, number and suffix: a row a suffix, a column a number; numbers come from numbered()."""
    prefix, digits, moving = numbers
    long = digits.dtype.itemsize
    if len(prefix) + long + max(map(len, suffixes)) > 55:  # more than one block
        return np.array([[int(hashlib.md5(prefix + d + s).hexdigest()[:15], 16) for d in digits.tolist()] for s in suffixes], np.uint64)
    fixed = np.zeros((len(suffixes), 64), np.uint8)
    for row, s in zip(fixed, suffixes):
        text = prefix + bytes(long) + s
        row[: len(text)] = np.frombuffer(text, np.uint8)
        row[len(text)], row[56], row[57] = 128, 8 * len(text) & 255, 8 * len(text) >> 8
    fixed = fixed.view("<u4")
    words = [fixed[:, k, None] if w is None else fixed[:, k, None] + w[None, :] for k, w in enumerate(moving)]
    shape = (len(suffixes), len(digits))
    a, b, c, d = (np.full(shape, x, np.uint32) for x in MD5_START)
    f, g = np.empty(shape, np.uint32), np.empty(shape, np.uint32)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, f), np.bitwise_and(f, b, f), np.bitwise_xor(f, d, f)
        elif i < 32:
            np.bitwise_xor(b, c, f), np.bitwise_and(f, d, f), np.bitwise_xor(f, c, f)
        elif i < 48:
            np.bitwise_xor(b, c, f), np.bitwise_xor(f, d, f)
        else:
            np.invert(d, f), np.bitwise_or(f, b, f), np.bitwise_xor(f, c, f)
        a += f
        a += words[MD5_WORD[i]] + MD5_ADD[i]
        np.left_shift(a, np.uint32(MD5_TURN[i]), f), np.right_shift(a, np.uint32(32 - MD5_TURN[i]), g)
        f |= g
        f += b
        a, b, c, d, f = d, f, b, c, a
    high, low = (x + np.uint32(start) for x, start in zip((a, b), MD5_START))
    return (high.byteswap().astype(np.uint64) << np.uint64(28)) | (low.byteswap() >> np.uint32(4)).astype(np.uint64)
