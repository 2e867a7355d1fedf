"""The alternating hash H and the integer hash, as Spark expressions and as plain Python.

Both are defined on unsigned 32-bit numbers, held here as BIGINT masked to 32 bits.  Lists of known length are unrolled
into one expression that stays in generated code; only strings fold over an array.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Start value and word mask of H, and the fraction of the integer hash (fixed values).
START, WORD = 0xAAAAAAAA, 0xFFFFFFFF
FRACTION = math.sqrt(2) - 1


def mask_of(bits: int) -> int:
    return (1 << bits) - 1


def _step(h: Column, v: Column, odd: bool) -> Column:
    word = F.lit(WORD)
    if odd:
        t = F.bitwise_not(((F.shiftleft(h, 11) + v).bitwiseAND(word)).bitwiseXOR(F.shiftright(h, 5)))
    else:
        t = F.shiftleft(h, 7).bitwiseXOR(v * F.shiftright(h, 3))
    return h.bitwiseXOR(t).bitwiseAND(word)


def hash_values(*values: Column | int, bits: int = 15) -> Column:
    """H of a list given as columns or numbers."""
    h = F.lit(START).cast("bigint")
    for i, v in enumerate(values):
        v = (v if isinstance(v, Column) else F.lit(v)).cast("bigint").bitwiseAND(F.lit(WORD))
        h = _step(h, v, bool(i % 2))
    return h.bitwiseAND(F.lit(mask_of(bits)))


def hash_array(values: Column, bits: int = 15) -> Column:
    """H of an array of numbers; null gives null, an empty array the masked start value."""
    start = F.struct(F.lit(START).cast("bigint").alias("h"), F.lit(0).alias("i"))

    def merge(s: Column, v: Column) -> Column:
        v = v.cast("bigint").bitwiseAND(F.lit(WORD))
        return F.struct(F.when(s["i"] % 2 == 0, _step(s["h"], v, False)).otherwise(_step(s["h"], v, True)).alias("h"), (s["i"] + 1).alias("i"))

    return F.aggregate(values, start, merge, lambda s: s["h"].bitwiseAND(F.lit(mask_of(bits))))


def bytes_of(text: Column) -> Column:
    """The signed UTF-8 bytes of a string, as an array of unsigned words."""
    digits = F.hex(F.encode(text, "UTF-8"))
    size = F.octet_length(text)
    at = F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))
    value = F.transform(at, lambda i: F.conv(F.substr(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("bigint"))
    return F.transform(value, lambda b: F.when(b > 127, b + F.lit(WORD - 255)).otherwise(b))


def hash_text(text: Column | str, bits: int = 15) -> Column:
    """H of a string's bytes."""
    return hash_array(bytes_of(F.col(text) if isinstance(text, str) else text), bits)


def int_hash(key: Column, seed: Column | int) -> Column:
    """The mixing hash of an id under a seed, in [0, 2^31)."""
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    word = F.lit(WORD)
    x = F.floor(((key * (seed.cast("bigint") + 1)).bitwiseAND(word)) * F.lit(FRACTION)).cast("bigint")

    def wrap(e: Column) -> Column:
        return (e + F.lit(1 << 31)).bitwiseAND(word) - F.lit(1 << 31)

    x = wrap(F.bitwise_not(x) + F.shiftleft(x, 15))
    x = x.bitwiseXOR(F.shiftright(x, 12))
    x = wrap(x + F.shiftleft(x, 2))
    x = x.bitwiseXOR(F.shiftright(x, 4))
    x = wrap(x * F.lit(2057))
    return x.bitwiseXOR(F.shiftright(x, 16)).bitwiseAND(F.lit((1 << 31) - 1))


def py_hash(values, bits: int = 15) -> int:
    """H in plain Python, of a string or of a list of integers."""
    if isinstance(values, str):
        values = [b - 256 if b > 127 else b for b in values.encode()]
    h = START
    for i, v in enumerate(values):
        v &= WORD
        t = ~(((h << 11) + v & WORD) ^ (h >> 5)) if i % 2 else (h << 7) ^ v * (h >> 3)
        h = (h ^ t) & WORD
    return h & mask_of(bits)


def py_int_hash(key: int, seed: int) -> int:
    x = int((key * (seed + 1) & WORD) * FRACTION)

    def wrap(e: int) -> int:
        return (e + (1 << 31) & WORD) - (1 << 31)

    x = wrap(~x + (x << 15))
    x ^= x >> 12
    x = wrap(x + (x << 2))
    x ^= x >> 4
    x = wrap(x * 2057)
    return (x ^ x >> 16) & (1 << 31) - 1


def prefix_states(codes: np.ndarray, length: int) -> np.ndarray:
    """For every start the H state after each of ``length`` characters, with the parity of the absolute place; 0 past the end."""
    n = len(codes)
    out = np.zeros((n, length), np.int64)
    h = np.full(n, START, np.uint64)
    word = np.uint64(WORD)
    for k in range(length):
        m = n - k
        if m <= 0:
            break
        v, s = codes[k:].astype(np.int64).view(np.uint64) & word, h[:m]
        odd = (np.arange(k, n) % 2).astype(bool)
        even_t = (s << np.uint64(7)) ^ (v * (s >> np.uint64(3)))
        odd_t = ~((((s << np.uint64(11)) + v) & word) ^ (s >> np.uint64(5)))
        h[:m] = (s ^ np.where(odd, odd_t, even_t)) & word
        out[:m, k] = h[:m].astype(np.int64)
    return out
