"""Schema validation of chunk rows (D9): split good rows from rejects."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filtra.config import MAX_LEN

REQUIRED = ("id", "kbId", "documentId", "embedding")


def row_checks(df: DataFrame, dim: int, max_len: Mapping[str, int] = MAX_LEN,
               required=REQUIRED, vec_col: str = "embedding") -> list:
    """(condition, reason) pairs that need only the row itself (stream-safe)."""
    checks = []
    for c in required:
        if c in df.columns:
            checks.append((F.col(c).isNull(), f"{c}_null"))
    for c, n in max_len.items():
        if c in df.columns:
            checks.append((F.char_length(c) > n, f"{c}_too_long"))
    if vec_col in df.columns:
        checks.append((F.size(vec_col) != dim, f"{vec_col}_dim"))
    return checks


def reasons_of(checks) -> "F.Column":
    return F.concat_ws(";", F.array_compact(F.array(*[F.when(cond, F.lit(name))
                                                      for cond, name in checks])))


def validate(df: DataFrame, dim: int, max_len: Mapping[str, int] = MAX_LEN,
             required=REQUIRED, vec_col: str = "embedding", id_col: str = "id"):
    """Return (good, rejected); rejected rows carry ``reasons`` (';'-joined).

    Checks: required fields non-null, string length limits, vector length,
    duplicate primary key. Duplicates are found by grouping the key column
    alone (vectors never enter that shuffle) and flagged by a join on the
    duplicate keys.
    """
    checks = row_checks(df, dim, max_len, required, vec_col)
    dups = df.groupBy(id_col).agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1") \
        .select(id_col, F.lit(True).alias("_dup"))
    marked = df.join(dups, id_col, "left")
    checks.append((F.coalesce(F.col("_dup"), F.lit(False)), "duplicate_id"))
    marked = marked.withColumn("reasons", reasons_of(checks)).drop("_dup")
    good = marked.filter(F.col("reasons") == "").drop("reasons")
    bad = marked.filter(F.col("reasons") != "")
    return good, bad
