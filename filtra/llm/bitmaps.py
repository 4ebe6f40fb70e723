"""Sets of hashes as bitmaps of a fixed size, for leaving out what cannot matter.

A bitmap holds the low bits of each hash: a value of the set is always found in
it, a value outside may be. So it may only drop work, never rows that count;
the more values, the less it drops.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 25  # 2**25 bits are 4 MB, whatever the corpus


def bitmap(values: DataFrame, col: str, bits: int = BITS) -> np.ndarray:
    """2**bits bits as bytes, one bit set for each value's low bits.

    Built by aggregates of 4 KB blocks; what reaches the driver is the bitmap itself.
    """
    at = F.col(col).bitwiseAND(F.lit((1 << bits) - 1)) + 1
    blocks = (values.select(at.alias("at"))
              .groupBy(F.bitmap_bucket_number("at").alias("block"))
              .agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("b")))
    out = np.zeros(1 << (bits - 3), dtype=np.uint8)
    for r in blocks.toLocalIterator():
        at = (r["block"] - 1) * 4096
        part = np.frombuffer(r["b"], dtype=np.uint8)
        out[at:at + 4096] = part[:len(out) - at]
    return out


def holds(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether each hash may be in the set."""
    low = h.view(np.uint64) & np.uint64(len(bits) * 8 - 1)
    return (bits[(low >> np.uint64(3)).astype(np.int64)] >> (low & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1
