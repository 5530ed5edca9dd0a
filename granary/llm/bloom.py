"""A Bloom filter of 64-bit hashes with a bounded size: built in Spark from map-side bitmaps, probed in tasks. Whatever
is in the set passes; how much else does depends on the set's size, so it may only save work."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

#: Bits for each hash, probes for each, and the filter's size at most: 16 MB, so that it may be broadcast.
BITS_EACH, PROBES, MOST_BITS = 32, 2, 2**27


def bloom(hashes: DataFrame, n: int) -> np.ndarray:
    """The filter of column h; n is about the number of its distinct values. The pieces of 4 kB that come to the driver
    are at most MOST_BITS together."""
    bits = 2**15
    while bits < min(MOST_BITS, n * BITS_EACH):
        bits *= 2
    out = np.zeros(bits // 8, np.uint8)
    places = F.explode(F.array(*[F.pmod(F.shiftrightunsigned("h", 29 * k), F.lit(bits)) for k in range(PROBES)])).alias("p")
    pieces = hashes.select(places).groupBy(F.bitmap_bucket_number(F.col("p") + 1).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("p") + 1)).alias("bits"))
    for r in pieces.collect():
        piece = np.frombuffer(r["bits"], np.uint8)
        out[(r["b"] - 1) * 4096 : (r["b"] - 1) * 4096 + len(piece)] = piece
    return out


def passes(filter_bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which of the hashes may be in the set."""
    out = np.ones(len(h), bool)
    for k in range(PROBES):
        p = ((h >> np.uint64(29 * k)) % np.uint64(8 * len(filter_bits))).astype(np.int64)
        out &= (filter_bits[p >> 3] >> (p & 7).astype(np.uint8) & 1).astype(bool)
    return out


def may_hold(filter_bits, h: Column) -> Column:
    """The same for a column, by a broadcast filter. Only the hashes go to Python, whatever the row holds besides."""

    @F.pandas_udf(BooleanType())
    def test(h: pd.Series) -> pd.Series:
        return pd.Series(passes(filter_bits.value, h.to_numpy(np.int64).view(np.uint64)))

    return test(h)
