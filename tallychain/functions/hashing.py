"""Digests: block hashes and pair hashes on Spark's own SHA-256, Keccak-256 in numpy."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

RATE = 136


def block_text(index: Column, ts: Column, data: Column) -> Column:
    """What is hashed of a block before its predecessor's hash; a null field is empty, not left out."""
    return F.concat(*[F.concat(F.coalesce(c.cast("string"), F.lit("")), F.lit("|")) for c in (index, ts, data)])


def block_hash(index: Column, ts: Column, data: Column, previous: Column) -> Column:
    return F.sha2(F.concat(block_text(index, ts, data), F.coalesce(previous, F.lit(""))), 256)


def unhex_strict(text: Column) -> Column:
    """Bytes of an even number of hex digits; anything else is an error."""
    return F.when(text.rlike("^([0-9a-fA-F]{2})*$"), F.unhex(text)).otherwise(F.raise_error(F.concat(F.lit("invalid hex: "), text)))


def unhex_prefixed(text: Column) -> Column:
    """Bytes of hex digits of either case with or without 0x before them; null for what is none."""
    return F.unhex(F.regexp_replace(text, "^0[xX]", ""))


def _permute(a: list[list[np.ndarray]]) -> None:
    """Keccak-f[1600] on lanes a[x][y] of many states at once."""
    rol = lambda v, n: v if n % 64 == 0 else v << np.uint64(n % 64) | v >> np.uint64(64 - n % 64)
    bit = 1
    for _ in range(24):
        c = [a[x][0] ^ a[x][1] ^ a[x][2] ^ a[x][3] ^ a[x][4] for x in range(5)]
        for x in range(5):
            d = c[x - 1] ^ rol(c[(x + 1) % 5], 1)
            a[x] = [v ^ d for v in a[x]]
        x, y, held = 1, 0, a[1][0]
        for t in range(24):
            x, y = y, (2 * x + 3 * y) % 5
            held, a[x][y] = a[x][y], rol(held, (t + 1) * (t + 2) // 2)
        for y in range(5):
            row = [a[x][y] for x in range(5)]
            for x in range(5):
                a[x][y] = row[x] ^ ~row[(x + 1) % 5] & row[(x + 2) % 5]
        for j in range(7):
            bit = (bit << 1 ^ (bit >> 7) * 0x71) % 256
            if bit & 2:
                a[0][0] = a[0][0] ^ np.uint64(1 << (1 << j) - 1)


def keccak256_many(items: list[bytes], pad: int = 1) -> list[bytes]:
    """Keccak-256 of each item; with pad 6 it is SHA3-256. All items advance block by block together, the longest ones first, so that a call
    costs as many rounds as its longest item has blocks."""
    order = sorted(range(len(items)), key=lambda i: -len(items[i]))
    blocks = [len(items[i]) // RATE + 1 for i in order]
    starts = np.concatenate(([0], np.cumsum(blocks))).astype(np.int64)
    filled = np.zeros(int(starts[-1]) * RATE, np.uint8)
    for k, i in enumerate(order):
        at = int(starts[k]) * RATE
        filled[at : at + len(items[i])] = np.frombuffer(items[i], np.uint8)
        filled[at + len(items[i])] ^= pad
        filled[int(starts[k + 1]) * RATE - 1] ^= 0x80
    lanes = filled.view("<u8").reshape(-1, RATE // 8)
    out: list[bytes] = [b""] * len(items)
    left = len(items)
    a = [[np.zeros(left, np.uint64) for _ in range(5)] for _ in range(5)]
    for block in range(blocks[0] if items else 0):
        now = lanes[starts[:left] + block]
        for w in range(RATE // 8):
            a[w % 5][w // 5] = a[w % 5][w // 5] ^ now[:, w]
        _permute(a)
        stay = left
        while stay and blocks[stay - 1] == block + 1:
            stay -= 1
        if stay < left:
            digests = np.stack([a[x][0][stay:] for x in range(4)], axis=1).astype("<u8")
            for k in range(stay, left):
                out[order[k]] = digests[k - stay].tobytes()
            a, left = [[v[:stay] for v in row] for row in a], stay
    return out


def keccak256(data: Column) -> Column:
    """Keccak-256 of a binary column, as bytes; null for null."""

    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        digests = iter(keccak256_many([bytes(x) for x in s if x is not None]))
        return pd.Series([None if x is None else next(digests) for x in s], dtype=object)

    return run(data)


def sha256_many(items: list[bytes]) -> list[bytes]:
    return [hashlib.sha256(x).digest() for x in items]
