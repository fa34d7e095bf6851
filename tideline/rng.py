"""Random numbers that are a function of seed and key, alike in Spark and SQL: the first 32 bits of an MD5."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def u01(seed: int | str, *key: Column) -> Column:
    """Uniform in [0, 1)."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in key]))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def u01_sql(seed: int | str, *key: str) -> str:
    parts = ", ".join(f"CAST({k} AS VARCHAR)" for k in key)
    return f"(CAST(concat('0x', substr(md5(concat_ws(':', '{seed}', {parts})), 1, 8)) AS BIGINT) / 4294967296.0)"


_SHIFTS = [s for row in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in row * 4]
_SINES = [int(abs(math.sin(i + 1)) * 4294967296) for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _first_words(m: np.ndarray) -> np.ndarray:
    """The first word of the MD5 of each column of ``m``: 16 rows of words, each column one padded block."""
    a, b, c, d = (np.full(m.shape[1], x, np.uint32) for x in _START)
    f, g = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
            k = i
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
            k = (5 * i + 1) % 16
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
            k = (3 * i + 5) % 16
        else:
            np.bitwise_not(d, out=f)
            f |= b
            f ^= c
            k = 7 * i % 16
        f += a
        f += m[k]
        f += np.uint32(_SINES[i])
        np.right_shift(f, 32 - _SHIFTS[i], out=g)
        f <<= _SHIFTS[i]
        f |= g
        f += b
        a, b, c, d, f = d, f, b, c, a
    return a + np.uint32(_START[0])


def u01_many(seeds: Sequence[int | str], key: str | None, numbers: np.ndarray, part: int = 8192) -> list[np.ndarray]:
    """:func:`u01` of (key, number) for ascending ``numbers`` from 0 on, an array per seed; many at a time, as texts of one length are
    hashed together. A key too long for one block of the hash is hashed number by number."""
    heads = [":".join([str(s), *([] if key is None else [key])]).encode() + b":" for s in seeds]
    n, last = len(numbers), int(numbers[-1]) if len(numbers) else 0
    if max(map(len, heads)) + len(str(last)) > 55:
        return [np.array([int.from_bytes(hashlib.md5(h + b"%d" % x).digest()[:4], "big") for x in numbers.tolist()], float) / 4294967296 for h in heads]
    cuts = np.searchsorted(numbers, [0, *(10**i for i in range(1, len(str(last)))), last + 1])
    blocks = np.zeros((len(heads), n, 64), np.uint8)
    for width, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:]), 1):
        digits = [(numbers[lo:hi] // 10 ** (width - 1 - i) % 10 + 48).astype(np.uint8) for i in range(width)]
        for block, head in zip(blocks, heads):
            at, b = len(head), block[lo:hi]
            b[:, :at] = np.frombuffer(head, np.uint8)
            for i, x in enumerate(digits):
                b[:, at + i] = x
            b[:, at + width] = 128
            b[:, 56:58] = np.frombuffer((8 * (at + width)).to_bytes(2, "little"), np.uint8)
    words = blocks.reshape(-1, 64).view("<u4")
    got = [_first_words(np.ascontiguousarray(words[i : i + part].T)) for i in range(0, len(words), part)]
    return list(np.concatenate([*got, np.empty(0, np.uint32)]).byteswap().astype(float).reshape(len(heads), n) / 4294967296)
