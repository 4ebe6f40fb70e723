"""Queries arriving as a stream, each answered with filtered top-k.

A row_number window is not allowed on a stream, so every micro-batch of
queries is answered by the blocked batch search (R2) inside ``foreachBatch``,
which reads the stored corpus once; output fields travel with the hits. Each
batch's answer is written to its own folder with overwrite, so a replayed
batch replaces rather than duplicates its output.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from filtra.config import OUTPUT_FIELDS
from filtra.operators.blocked import search_blocked


def stream_search(spark: SparkSession, corpus: DataFrame, queries_dir: str, schema: StructType,
                  sink_dir: str, checkpoint_dir: str, k: int = 10, metric: str = "IP",
                  fields: Sequence[str] = OUTPUT_FIELDS, max_files_per_trigger: int = 1) -> int:
    src = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
           .parquet(queries_dir))

    done = {"batches": 0}

    def answer(batch: DataFrame, batch_id: int) -> None:
        done["batches"] += 1
        res = search_blocked(corpus, batch, k=k, metric=metric, fields=fields)
        res.write.mode("overwrite").parquet(f"{sink_dir}/batch={batch_id}")

    q = (src.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint_dir)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return done["batches"]
