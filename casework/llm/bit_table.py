"""A table of bits of bounded size that tells which keys may be wanted.

It lets others through where two keys share a bit, so an exact step has to follow;
it never holds a wanted key back.  The bits are set in Spark and only the finished
table, at most ``MOST_BITS`` of them (16 MB), comes to the driver and goes to the tasks.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, functions as F

LEAST_BITS, MOST_BITS = 1 << 20, 1 << 27
#: Bits of one bitmap of ``bitmap_construct_agg``.
SLAB = 32_768


def build(keys: DataFrame, key: str = "key") -> bytes:
    """The compressed table of a column of evenly spread longs: 16 bits a key, within the bounds."""
    bits = LEAST_BITS
    wanted = 16 * keys.count()
    while bits < min(wanted, MOST_BITS):
        bits *= 2
    place = F.pmod(F.col(key), F.lit(bits))
    slabs = (
        keys.select(F.floor(place / SLAB).cast("int").alias("slab"), (place % SLAB).cast("int").alias("bit"))
        .groupBy("slab")
        .agg(F.expr("bitmap_construct_agg(bit)").alias("bits"))
    )
    table = np.zeros(bits // 8, np.uint8)
    for row in slabs.toLocalIterator():
        table[row.slab * SLAB // 8 : (row.slab + 1) * SLAB // 8] = np.frombuffer(bytes(row.bits), np.uint8)
    return zlib.compress(table.tobytes(), 1)


def opened(table: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(table), np.uint8)


def maybe(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """For each 64-bit key whether it may be wanted."""
    place = keys.astype(np.uint64, copy=False) & np.uint64(8 * len(table) - 1)
    return (table[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
