"""Bloom filters of a fixed size over 64-bit hashes.

A filter has 2**log2_bits bits whatever it holds, so it may be sent to every task. It only
spares shuffles: what it lets through by mistake is removed by the join that follows, so a
filter that is too full costs time and never a result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Bloom:
    def __init__(self, bits: np.ndarray, log2_bits: int):
        self.bits, self.log2_bits = bits, log2_bits

    def __contains__(self, hashes: np.ndarray) -> bool:
        raise TypeError("use holds()")

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        """For each unsigned hash, whether it may be in the filter."""
        found = np.ones(len(hashes), dtype=bool)
        for shift in _shifts(self.log2_bits):
            at = (hashes >> np.uint64(shift)) & np.uint64((1 << self.log2_bits) - 1)
            word = self.bits[(at >> np.uint64(6)).astype(np.int64)]
            found &= (word >> (at & np.uint64(63))) & np.uint64(1) == 1
        return found


def _shifts(log2_bits: int) -> tuple[int, int]:
    return 64 - log2_bits, 64 - 2 * log2_bits


def build(df: DataFrame, column: str, log2_bits: int = 22) -> Bloom:
    """Filter of a long column of well-mixed hashes; 2**(log2_bits - 6) numbers reach the driver at most."""
    assert 7 <= log2_bits <= 28
    at = F.explode(
        F.array(
            *[
                F.shiftrightunsigned(column, shift).bitwiseAND(F.lit((1 << log2_bits) - 1))
                for shift in _shifts(log2_bits)
            ]
        )
    )
    words = (
        df.where(F.col(column).isNotNull())
        .select(at.alias("at"))
        .groupBy(F.shiftright("at", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))
        .toArrow()
    )
    bits = np.zeros(1 << (log2_bits - 6), dtype=np.uint64)
    if len(words):
        bits[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return Bloom(bits, log2_bits)
