"""Filters of a fixed size for keys of any number."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F


def _bits(key: Column, bits: int) -> list[Column]:
    return [key.bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned(key, 32).bitwiseAND(F.lit(bits - 1))]


class KeyFilter:
    """A bloom filter of a table's 64-bit hashes ``key``: two of ``bits`` bits (a power of two) are set for each.

    Spark sets the bits, word by word; bits / 64 words at most come to the driver. Every key passes; what else
    passes grows with the number of keys.
    """

    def __init__(self, keys: DataFrame, bits: int):
        places = keys.select(F.explode(F.array(*_bits(F.col("key"), bits))).alias("bit"))
        words = places.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("set")).toArrow()
        self.words, self.mask = np.zeros(bits // 64, np.uint64), np.uint64(bits - 1)
        self.words[words["word"].to_numpy()] = words["set"].to_numpy().view(np.uint64)

    def maybe(self, keys: np.ndarray) -> np.ndarray:
        """Whether each of the keys (unsigned) may be in the table."""
        first, second = keys & self.mask, (keys >> np.uint64(32)) & self.mask
        six, low = np.uint64(6), np.uint64(63)
        return ((self.words[first >> six] >> (first & low)) & (self.words[second >> six] >> (second & low)) & np.uint64(1)).astype(bool)
