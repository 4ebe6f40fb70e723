"""Order-dependent numbering without a single-partition window.

``row_number() over (partition by p order by o)`` and running sums are
computed as in a parallel prefix sum: rows are range-sorted by (p, o) and
checkpointed, so that every partition is a fixed block of the order; each block
is numbered locally, and a small per-block totals table supplies the offsets.
No task holds more than one block, however skewed the partition key is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filtra.session import shared_dir

_POSITION = (1 << 33) - 1  # monotonically_increasing_id keeps the position in 33 bits


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys match null keys; the left side's keys are kept."""
    side = right.select(*[F.col(k).alias(f"_on_{k}") for k in keys],
                        *[F.col(c) for c in right.columns if c not in keys])
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_on_{k}"))
    return left.join(side, cond, how).drop(*[f"_on_{k}" for k in keys])


def _blocks(df: DataFrame, keys: list[str], blocks: int | None) -> DataFrame:
    """Rows in blocks of the key order: ``_blk`` numbers the block, ``_pos`` the row in it.

    The checkpoint fixes the blocks: later reads see the same rows in them.
    """
    shared_dir(df.sparkSession)
    ranged = df.repartitionByRange(blocks, *keys) if blocks else df.repartitionByRange(*keys)
    fixed = ranged.sortWithinPartitions(*keys).checkpoint(eager=True)
    return (fixed.withColumn("_blk", F.spark_partition_id().cast("long"))
            .withColumn("_pos", F.monotonically_increasing_id().bitwiseAND(F.lit(_POSITION))))


def row_index(df: DataFrame, partition_cols: Sequence[str], order_cols: Sequence[str],
              out: str, blocks: int | None = None) -> DataFrame:
    """Add ``out`` = 1-based row number per ``partition_cols`` in ``order_cols`` order.

    A hot partition key spans many blocks. The counts of earlier blocks -- a table
    of at most blocks + keys rows -- give the offsets. Null keys form a partition.
    """
    p = list(partition_cols)
    tagged = _blocks(df, [*p, *order_cols], blocks)
    totals = tagged.groupBy(*p, "_blk").agg(F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_first"))
    before = Window.partitionBy(*p).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*p, "_blk", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return (join_on(tagged, offsets, [*p, "_blk"])
            .withColumn(out, (F.col("_off") + F.col("_pos") - F.col("_first") + 1).cast("long"))
            .drop("_blk", "_pos", "_first", "_off"))


def _offset_sums(tagged: DataFrame, p: list[str], order: list[str], value_col: str, out: str,
                 exclusive: bool) -> DataFrame:
    """Sums inside (partition, block) plus the sums of the partition's earlier blocks."""
    within = Window.partitionBy(*p, "_blk").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    local = tagged.withColumn("_loc", F.sum(value_col).over(within))
    totals = tagged.groupBy(*p, "_blk").agg(F.sum(value_col).alias("_t"))
    before = Window.partitionBy(*p).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*p, "_blk", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_off"))
    res = join_on(local, offsets, [*p, "_blk"])
    total = F.col("_off") + F.col("_loc")
    if exclusive:
        total = total - F.col(value_col)
    return res.withColumn(out, total).drop("_blk", "_loc", "_off")


def running_sum_by_index(df: DataFrame, partition_cols: Sequence[str], index_col: str,
                         value_col: str, out: str, block_size: int = 1 << 16,
                         exclusive: bool = False) -> DataFrame:
    """Running ``sum(value)`` per partition in ``index_col`` order.

    ``index_col`` must be a dense 1-based position (e.g. from :func:`row_index`),
    so that ``index div block_size`` cuts every partition into blocks of at most
    ``block_size`` rows; the window then runs per (partition, block).
    """
    blk = F.floor((F.col(index_col) - 1) / F.lit(block_size)).cast("long")
    return _offset_sums(df.withColumn("_blk", blk), list(partition_cols), [index_col], value_col, out, exclusive)


def running_sum(df: DataFrame, partition_cols: Sequence[str], order_cols: Sequence[str],
                value_col: str, out: str, exclusive: bool = False,
                blocks: int | None = None) -> DataFrame:
    """Running ``sum(value)`` per partition in ``order_cols`` order (rows frame).

    Same blocks as :func:`row_index`. ``exclusive`` leaves the current row out (the
    sum of all earlier rows).
    """
    p = list(partition_cols)
    tagged = _blocks(df, [*p, *order_cols], blocks)
    return _offset_sums(tagged, p, ["_pos"], value_col, out, exclusive).drop("_pos")
