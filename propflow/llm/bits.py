"""A set of 64-bit hashes in a bitmap of bounded size."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

LEAST_BITS, MOST_BITS = 16, 28  # as powers of two: at most 32 MB
BITS_PER_HASH = 16


class Bits:
    """A set of hashes that may say yes to others too."""

    def __init__(self, cells: np.ndarray, power: int):
        self.cells, self.power = cells, power

    def has(self, hashed: np.ndarray) -> np.ndarray:
        place = hashed >> np.uint64(64 - self.power)
        return (self.cells[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def bitmap(hashed: DataFrame, least: int = LEAST_BITS, most: int = MOST_BITS) -> Bits:
    """The bits of column `h`, sixteen per hash as far as the largest bitmap goes; set in the tasks, merged by word."""
    power = min(max((hashed.count() * BITS_PER_HASH).bit_length(), least), most)
    word = F.shiftrightunsigned("h", 64 - power + 6).cast("int")
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - power}) & 63 as int))")
    words = hashed.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    cells = np.zeros(1 << (power - 6), dtype=np.uint64)  # at most 2 ** (MOST_BITS - 6) words
    cells[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return Bits(cells, power)
