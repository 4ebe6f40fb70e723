"""Streaming ingest of chunk files into the corpus table.

readStream (bounded files per trigger) -> row-level validation -> duplicate keys
against a state store -> good rows and rejects as Parquet, a folder per
micro-batch. Restarting on the same checkpoint skips committed batches, and a
batch that failed half-way overwrites its own folders, so a resumed ingest adds
no duplicates and loses no rejects.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from filtra.operators.validate import reasons_of, row_checks
from filtra.session import ship_package

DUPLICATE = "duplicate_id"


def mark_duplicates(rows: DataFrame, key: str = "id", horizon: str | None = None) -> DataFrame:
    """Streaming rows with ``duplicate_id`` among their reasons if their key was seen before.

    The first row of a key that has no other reason is kept; what the state store holds per key is
    one number. A row with another reason neither takes a key nor is a duplicate, so null keys
    need no state. With ``horizon`` (e.g. "7 days", by the files' modification times, which are
    the stream's watermark) keys older than that are forgotten and their state is dropped.
    """
    ship_package(rows.sparkSession)
    out = StructType([*rows.schema.fields])
    plain = StructType([f for f in out.fields if f.name not in ("_when", "_salt")])
    names = plain.names
    keep_ms = int(pd.Timedelta(horizon).total_seconds() * 1000) if horizon else None

    def first_only(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen = state.exists
        for pdf in parts:
            fine = pdf["reasons"] == ""
            again = fine & ((fine.cumsum() > 1) | seen)
            seen = seen or bool(fine.any())
            pdf["reasons"] = pdf["reasons"].where(~again, DUPLICATE)
            yield pdf[names]
        if seen:
            state.update((1,))
            if keep_ms is not None:
                state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), 0) + keep_ms)

    timeout = GroupStateTimeout.EventTimeTimeout if horizon else GroupStateTimeout.NoTimeout
    # rows that cannot take a key are spread by their values instead of meeting in the group of their key
    plain_cols = [f.name for f in out.fields if not f.dataType.simpleString().startswith("map")]
    salted = rows.withColumn("_salt", F.when(F.col("reasons") != "", F.xxhash64(*plain_cols)).otherwise(F.lit(0)))
    return salted.groupBy(key, "_salt").applyInPandasWithState(first_only, plain, StructType.fromDDL("seen int"),
                                                               "append", timeout)


def stream_ingest(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint_dir: str,
                  schema: StructType, dim: int, max_files_per_trigger: int = 2,
                  rejects_dir: str | None = None, interval: str | None = None,
                  unique: str | None = None, horizon: str | None = None, rates_dir: str | None = None):
    """Ingest arriving chunk files.

    Without ``interval``: run until all files present are ingested
    (availableNow) and return the number of micro-batches. With ``interval``
    (e.g. "30 seconds"): start a continuously running query that commits one
    micro-batch per interval, and return its handle. Rows with a reason go to
    ``rejects_dir`` either way; both folders are partitioned by ``batch``.
    ``unique`` names a key whose repetitions, in this batch or an earlier one, are rejects
    (``horizon``: see :func:`mark_duplicates`). ``rates_dir`` gets one row per batch:
    rows read, kept, rejected, and the seconds of writing them (G2's ingest rate).
    """
    src = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
           .parquet(source_dir))
    checks = reasons_of(row_checks(src, dim))
    if unique and horizon:
        src = src.withColumn("_when", F.col("_metadata.file_modification_time")).withWatermark("_when", "0 seconds")
    checked = src.withColumn("reasons", checks)
    if unique:
        checked = mark_duplicates(checked, unique, horizon)
    done = {"batches": 0}

    def write(batch, batch_id: int) -> None:
        # one pass: the batch is validated once and kept while both sides are written;
        # a folder per batch id is overwritten when a failed batch is run again
        began = time.time()
        batch.persist()
        try:
            _put(batch.filter(F.col("reasons") == "").drop("reasons"), sink_dir, batch_id)
            if rejects_dir:
                _put(batch.filter(F.col("reasons") != ""), rejects_dir, batch_id)
            if rates_dir:
                counted = batch.agg(F.count(F.lit(1)).alias("rows_in"),
                                    F.count_if(F.col("reasons") == "").alias("rows_kept"))
                _put(counted.select("rows_in", "rows_kept", (F.col("rows_in") - F.col("rows_kept")).alias("rows_rejected"),
                                    F.lit(time.time() - began).alias("seconds")).coalesce(1), rates_dir, batch_id)
        finally:
            batch.unpersist()
        done["batches"] += 1

    w = (checked.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint_dir))
    if interval is not None:
        return w.trigger(processingTime=interval).start()
    q = w.trigger(availableNow=True).start()
    q.awaitTermination()
    return done["batches"]


def _put(df, folder: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/batch={batch_id}")


def ingest_rate(rates: DataFrame) -> DataFrame:
    """Batch, rows_in, rows_kept, rows_rejected, rows_per_s of every batch and, as batch null, of all.

    The divisor is at least a millisecond.
    """
    per = rates.groupBy("batch").agg(*[F.sum(c).alias(c) for c in ("rows_in", "rows_kept", "rows_rejected", "seconds")])
    total = per.agg(*[F.sum(c).alias(c) for c in per.columns[1:]]).withColumn("batch", F.lit(None).cast("int"))
    both = per.unionByName(total.filter("rows_in is not null"))
    return both.select("batch", "rows_in", "rows_kept", "rows_rejected",
                       F.round(F.col("rows_in") / F.greatest(F.col("seconds"), F.lit(0.001)), 2).alias("rows_per_s"))
