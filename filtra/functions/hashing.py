"""Reproducible uniform draws from key hashes.

``u = int(first 8 hex digits of md5(salt || key)) / 2^32`` is the same in any
engine that has md5, so generated attributes can be checked by SQL, and it
does not depend on partitioning (unlike ``rand(seed)``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def md5_uint32(salt: str, key) -> Column:
    k = F.col(key) if isinstance(key, str) else key
    h = F.md5(F.concat(F.lit(salt), k.cast("string")))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("long")


def md5_uniform(salt: str, key) -> Column:
    """Uniform in [0, 1)."""
    return md5_uint32(salt, key) / F.lit(float(1 << 32))


def xx_uniform(seed: int, *cols) -> Column:
    """Uniform in (0, 1) from xxhash64; fast, Spark-only (no SQL oracle needed)."""
    h = F.xxhash64(F.lit(seed), *cols)
    # 53 random bits -> (0, 1); +0.5 keeps it off 0 for log().
    return (F.shiftrightunsigned(h, 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
