"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filtra.session import scratch_path, shared_dir, ship_package

# Words are runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

# A table of at most this many rows (a few hundred bytes each) may be broadcast.
BROADCAST_ROWS = 100_000
JOIN_SALT = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder; cuts lineage, and the size estimate with it.

    Spark hands a checkpoint the size it estimated, and a join's estimate is the product of its
    sides': from round to round of a loop these numbers double their digits until the driver
    is full of them. The rows, their partitioning and order stay as the checkpoint has them.
    """
    spark = df.sparkSession
    shared_dir(spark)
    done = df.checkpoint(eager=True)
    rows = done._jdf.queryExecution().logical()
    none = spark._jvm.scala.Option.empty()
    plain = spark._jvm.org.apache.spark.sql.execution.LogicalRDD(
        rows.output(), rows.rdd(), rows.outputPartitioning(), rows.outputOrdering(), rows.isStreaming(), none,
        spark._jsparkSession, none, none)
    return DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, plain), spark)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write as Parquet into the shared folder and read back (compressed, columnar)."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)


def fold(col: str, mod: int) -> Column:
    """crc32 of the id written as text, modulo ``mod`` (null id: the empty text)."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % mod


def whole_text(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def join_small(left: DataFrame, small: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Null-safe equi-join to a table that is usually small.

    At most ``BROADCAST_ROWS`` rows (counted) are broadcast. A larger table is
    replicated over ``JOIN_SALT`` salts instead, so that a hot key of the left
    side is spread over as many tasks.
    """
    right = small.select(*[F.col(k).alias(f"_r_{k}") for k in keys],
                         *[F.col(c) for c in small.columns if c not in keys])
    if right.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        on = _null_safe(keys)
        return left.join(F.broadcast(right), on, how).drop(*[f"_r_{k}" for k in keys])
    salted = right.withColumn("_r_salt", F.explode(F.sequence(F.lit(0), F.lit(JOIN_SALT - 1))))
    # the salt only spreads rows; any value is right
    left = left.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(JOIN_SALT)).cast("int"))
    on = _null_safe(keys) & (F.col("_salt") == F.col("_r_salt"))
    return left.join(salted, on, how).drop("_salt", "_r_salt", *[f"_r_{k}" for k in keys])


def _null_safe(keys: list[str]) -> Column:
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return on


def settled(df: DataFrame, cols: list[str]) -> DataFrame:
    """``df`` with ``cols`` computed at this point of the plan.

    A filter on a computed column is otherwise moved below the steps that compute it, with all
    of them written out inside it, again and again for columns used more than once. It does
    not pass a generator; this one gives one row a row.
    """
    rest = [F.col(c) for c in df.columns if c not in cols]
    packed = df.select(*rest, F.explode(F.array(F.struct(*cols))).alias("_settled"))
    return packed.select(*rest, *[F.col(f"_settled.{c}").alias(c) for c in cols])


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
