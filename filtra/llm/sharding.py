"""Sharding by a Feistel permutation over global row numbers (operator 10).

Rows are put into a total order, numbered 0..N-1, and the number is permuted
by a keyed Feistel network on the smallest even-bit domain that holds N;
values outside [0, N) walk the cycle until they fall inside. Position ``p``
of the permutation is shard ``p mod S``, slot ``p div S``: shard counts differ
by at most one, and any row's place follows from its number alone.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filtra.llm.common import cut, ship_package, table

SHARDS = 24
ROUNDS = 6
SEED = 20240917
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser, vectorised (wraps modulo 2**64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _round_keys(seed: int, rounds: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix(np.arange(1, rounds + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed))


def feistel(x: np.ndarray, n: int, seed: int = SEED, rounds: int = ROUNDS) -> np.ndarray:
    """The permutation of [0, n) applied to each value of ``x``."""
    x = np.asarray(x, dtype=_U)
    if n <= 1:
        return x.copy()
    half = _U(max(1, ((n - 1).bit_length() + 1) // 2))
    low = _U((1 << int(half)) - 1)
    keys = _round_keys(seed, rounds)

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> half, v & low
        for k in keys:
            left, right = right, left ^ (_mix(right + k) & low)
        return (left << half) | right

    with np.errstate(over="ignore"):
        y = once(x)
        out = np.nonzero(y >= _U(n))[0]
        while len(out):  # cycle walking: the domain is below 4 n, so few steps
            y[out] = once(y[out])
            out = out[y[out] >= _U(n)]
    return y


def number_rows(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """Add 0-based global row numbers in the order of ``order``.

    A range shuffle and a sort inside partitions, checkpointed so that the
    partitions are fixed; a partition's offset is the count of rows before it
    (one number per partition). Equal rows are spread by a salt: a value that
    fills a third of the table does not land in one task.
    """
    salted = df.withColumn("_salt", F.xxhash64(F.monotonically_increasing_id()))
    fixed = cut(salted.repartitionByRange(*order, "_salt").sortWithinPartitions(*order, "_salt")
                .drop("_salt"))
    tagged = fixed.withColumn("_pid", F.spark_partition_id())
    counts = sorted((r["_pid"], r["n"]) for r in
                    tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("n")).collect())
    offsets, total = [], 0
    for pid, n in counts:
        offsets.append((pid, total))
        total += n
    off = df.sparkSession.createDataFrame(offsets, "_opid int, _off long")
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    # one row per partition: bounded by the partition count
    return (tagged.withColumn("_in", inside)
            .join(F.broadcast(off), F.col("_pid") == F.col("_opid"))
            .withColumn(out, F.col("_off") + F.col("_in"))
            .drop("_pid", "_opid", "_off", "_in")), total


def shard_rows(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, row_number, shard, slot for every row of ``docs``.

    Null and empty texts have size 8 and crc 0. Rows are ordered by doc_id (nulls
    first), then crc and size; repeated rows are numbered apart (which of two
    equal rows gets which place does not matter). An empty table gives no rows.
    Only ``doc_id`` and ``text`` are read, so other columns cannot clash.
    """
    ship_package(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"))
    numbered, n = number_rows(base, ["doc_id", "text_crc32", "size"], "row_number")

    @F.pandas_udf("shard int, slot long")
    def place(row: pd.Series) -> pd.DataFrame:
        p = feistel(row.to_numpy(dtype=np.uint64), n, seed).astype(np.int64)
        return pd.DataFrame({"shard": (p % shards).astype(np.int32), "slot": p // shards})

    return (numbered.withColumn("_p", place("row_number"))
            .select("doc_id", "size", "text_crc32", "row_number",
                    F.col("_p.shard").alias("shard"), F.col("_p.slot").alias("slot")))


def op10(spark, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
