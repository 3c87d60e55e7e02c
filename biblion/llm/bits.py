"""A bit array over 64-bit keys that spares work: a key that was not put in is let through rarely, one that was always.

It only decides what is moved; the join after it decides what is right. Its size follows the number of keys
between LEAST and MOST bits (MOST is 32 MB), so that a key in PER_KEY gets through by chance; with many more than
two million keys it lets more through, and the join does the rest.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST, MOST, PER_KEY = 16, 28, 128


def size_bits(keys: int, least: int = LEAST, most: int = MOST) -> int:
    """log2 of the number of bits for so many keys."""
    return min(max((max(keys, 1) * PER_KEY - 1).bit_length(), least), most)


def key_bits(rows: DataFrame, column: str, keys: int, least: int = LEAST, most: int = MOST) -> np.ndarray:
    """Words of 64 bits with one bit set for each value of column; 2**most / 64 rows come to the driver at most."""
    size = size_bits(keys, least, most)
    slot = F.col(column).bitwiseAND(F.lit((1 << size) - 1).cast("long"))
    word = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("slot").bitwiseAND(63).cast("int"))).alias("word")
    got = rows.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("at")).agg(word).toArrow()
    out = np.zeros(1 << size - 6, np.uint64)
    out[got.column("at").to_numpy()] = got.column("word").to_numpy().view(np.uint64)
    return out


def bits_of(keys: np.ndarray, least: int = LEAST, most: int = MOST) -> np.ndarray:
    """The same for keys that are on the driver."""
    size = size_bits(len(keys), least, most)
    slot = keys & np.uint64((1 << size) - 1)
    out = np.zeros(1 << size - 6, np.uint64)
    np.bitwise_or.at(out, (slot >> np.uint64(6)).astype(np.int64), np.uint64(1) << (slot & np.uint64(63)))
    return out


def passing(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether each key may be one that was put in."""
    slot = key & np.uint64(len(bits) * 64 - 1)
    return (bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)
