"""Corpus layouts and result sinks.

All paths are expected on shared storage (see ``filtra.session.scratch_path``).
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from filtra.config import (CHUNKS_PER_DOC_MAX, CHUNKS_PER_DOC_MIN, NUM_PARTITIONS, SEED, SPARSE_NNZ_ROW, SPARSE_VOCAB,
                           TOP_K, ZIPF_ALPHA, PoolSpec)
from filtra.operators.ordering import row_index

# Rows per output file of a layout write: keeps the files of a hot key even.
MAX_RECORDS_PER_FILE = 1_000_000
# Rows and bytes a writing task gets, about: how many tasks write a key follows its rows.
ROWS_PER_WRITER = 1_000_000
BYTES_PER_WRITER = 64 << 20
# Hash buckets of a layout for joins on documentId.
DOCUMENT_BUCKETS = 64
# Values of a clustered field up to which their ranks are broadcast; the rows themselves are then moved once.
BROADCAST_VALUES = 100_000
# Bits of a field's rank that take part in the clustering order.
RANK_BITS = 8


def bucket_of(col, n: int = NUM_PARTITIONS):
    """Hash bucket of a key: pmod(xxhash64(key), n). On a literal it folds to a
    constant, so a filter on the key can name its bucket for partition pruning."""
    c = F.col(col) if isinstance(col, str) else col
    return F.pmod(F.xxhash64(c), F.lit(n)).cast("int")


def row_bytes(df: DataFrame):
    """About the bytes of a row: its texts in full, its arrays by their elements."""
    out = F.lit(8 * len(df.columns)).cast("long")
    for f in df.schema.fields:
        if f.dataType.typeName() == "string":
            out = out + F.coalesce(F.octet_length(f.name), F.lit(0))
        elif f.dataType.typeName() == "array":
            out = out + F.greatest(F.size(f.name), F.lit(0)) * 8
    return out


def writers(df: DataFrame, mean_bytes: float | None = None) -> int:
    """How many tasks write ``df``: by its rows and by their bytes, whichever asks for more.

    ``mean_bytes`` is the mean size of a row where the caller knows it; measuring it here
    reads every column.
    """
    if mean_bytes is None:
        r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(row_bytes(df)).alias("b")).first()
        n, size = r["n"], r["b"] or 0
    else:
        n = df.count()
        size = n * mean_bytes
    return max(1, -(-n // ROWS_PER_WRITER), math.ceil(size / BYTES_PER_WRITER))


def write_corpus(df: DataFrame, path: str, by: str = "kbId", mode: str = "errorifexists",
                 num_partitions: int = NUM_PARTITIONS, key: str = "kbId",
                 sort_within: str | None = "id") -> None:
    """Write a corpus partitioned by the key (``by="kbId"``) or by its hash
    bucket (``by="bucket"``, column ``kb_bucket``).

    Rows are dealt to writers by ranges of (key, ``sort_within``): as many writers as the
    corpus's rows and bytes ask for, so a hot key has as many as its rows need and small keys
    share one. Files are capped at MAX_RECORDS_PER_FILE rows and sorted by ``sort_within``
    for min/max skipping.
    """
    if by not in ("kbId", "bucket"):
        raise ValueError("by must be 'kbId' or 'bucket'")
    out = df
    part_col = key
    if by == "bucket":
        out = out.withColumn("kb_bucket", bucket_of(key, num_partitions))
        part_col = "kb_bucket"
    order = [part_col, sort_within or "id"]
    out = out.repartitionByRange(writers(df), *order)
    if sort_within:
        out = out.sortWithinPartitions(*order)
    (out.write.mode(mode).option("maxRecordsPerFile", MAX_RECORDS_PER_FILE)
     .partitionBy(part_col).parquet(path))


def field_ranks(df: DataFrame, field: str, bits: int = RANK_BITS) -> DataFrame:
    """value, rank: the field's distinct values in order, scaled to ``bits`` bits (one row a value)."""
    values = df.select(F.col(field).alias("value")).filter("value is not null").distinct()
    numbered = row_index(values, [], ["value"], "at")
    n = max(1, numbered.count())
    return numbered.select("value", F.floor((F.col("at") - 1) * (1 << bits) / F.lit(n)).cast("long").alias("rank"))


def interleaved(ranks: Sequence[str], bits: int = RANK_BITS):
    """One number from the rank columns, their bits taken in turn, highest first."""
    out = F.lit(0).cast("long")
    for b in range(bits):
        for i, r in enumerate(ranks):
            bit = F.shiftright(F.col(r), b).bitwiseAND(F.lit(1).cast("long"))
            out = out.bitwiseOR(F.shiftleft(bit, b * len(ranks) + i))
    return out


def write_clustered(df: DataFrame, path: str, fields: Sequence[str] = ("study", "site", "patient", "visit"),
                    key: str = "kbId", mode: str = "errorifexists", row_group_bytes: int | None = None,
                    bits: int = RANK_BITS, mean_bytes: float | None = None) -> None:
    """D6 clustered on several fields: partitioned by the key, and within a key ordered by the
    interleaved bits of the fields' ranks.

    Rows that agree in some of the fields lie near each other, so a row group spans a small
    range of every field and a filter on any of them skips the others by min/max. Null values
    come first. Writers are ranges of (key, order), as many as the rows and their bytes need
    (``mean_bytes``: see :func:`writers`).
    """
    fields = list(fields)
    if bits * len(fields) > 62:
        raise ValueError("the fields' bits must fit into a long")
    out = df
    for f in fields:
        ranks = field_ranks(df, f, bits).withColumnsRenamed({"value": f"_v_{f}", "rank": f"_r_{f}"})
        if ranks.limit(BROADCAST_VALUES + 1).count() <= BROADCAST_VALUES:
            ranks = F.broadcast(ranks)
        out = out.join(ranks, F.col(f) == F.col(f"_v_{f}"), "left").drop(f"_v_{f}")
        out = out.withColumn(f"_r_{f}", F.coalesce(F.col(f"_r_{f}"), F.lit(0)))
    out = out.withColumn("_z", interleaved([f"_r_{f}" for f in fields], bits)).drop(*[f"_r_{f}" for f in fields])
    order = [key, "_z", "id"]
    # every field is dictionary-encoded; a Bloom filter of the ids and documents helps point reads
    w = (out.repartitionByRange(writers(df, mean_bytes), *order).sortWithinPartitions(*order).drop("_z")
         .write.mode(mode).option("maxRecordsPerFile", MAX_RECORDS_PER_FILE)
         .option("parquet.bloom.filter.enabled#documentId", "true"))
    if row_group_bytes:
        w = w.option("parquet.block.size", str(int(row_group_bytes)))
    w.partitionBy(key).parquet(path)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def key_filter(key_value: str, key: str = "kbId", by: str = "kbId",
               num_partitions: int = NUM_PARTITIONS):
    """Predicate for one key value that prunes partitions on either layout:
    on the bucket layout the derived ``kb_bucket = bucket(value)`` is added,
    since Spark cannot infer it from ``kbId = value``."""
    cond = F.col(key) == key_value
    if by == "bucket":
        cond = cond & (F.col("kb_bucket") == bucket_of(F.lit(key_value), num_partitions))
    return cond


def write_bucketed(df: DataFrame, path: str, by: str, buckets: int = DOCUMENT_BUCKETS) -> str:
    """Store ``df`` in ``buckets`` hash buckets of ``by``, sorted by it, and return its table name.

    A join on ``by`` with anything else moves the other side only. The table is external: its
    files lie under ``path``, the session catalog knows how they are bucketed.
    """
    name = _bucketed_name(path)
    (df.repartition(buckets, by).write.mode("overwrite").bucketBy(buckets, by).sortBy(by)
     .option("maxRecordsPerFile", MAX_RECORDS_PER_FILE).option(f"parquet.bloom.filter.enabled#{by}", "true")
     .option("path", path).saveAsTable(name))
    return name


def _bucketed_name(path: str) -> str:
    return "bucketed_" + re.sub("[^A-Za-z0-9]+", "_", path.rstrip("/").rsplit("/", 1)[-1])


def read_bucketed(spark: SparkSession, path: str) -> DataFrame:
    return spark.table(_bucketed_name(path))


def run_settings(dim: int, **more) -> dict:
    """What a run was made with: the fixed values of the workload and the given ones."""
    return {"dim": dim, "seed": SEED, "top_k": TOP_K, "alpha": ZIPF_ALPHA, "sparse_vocab": SPARSE_VOCAB,
            "sparse_nnz": SPARSE_NNZ_ROW, "chunks_min": CHUNKS_PER_DOC_MIN, "chunks_max": CHUNKS_PER_DOC_MAX,
            "pools": PoolSpec().as_dict(), **more}


def write_manifest(profile: DataFrame, path: str, extra: dict | None = None,
                   mode: str = "errorifexists") -> None:
    """The one-row dataset profile and the run's settings as a JSON object (one file)."""
    out = profile
    if extra is not None:
        out = out.withColumn("settings", F.lit(json.dumps(extra, sort_keys=True)))
    out.coalesce(1).write.mode(mode).json(path)


def read_manifest(spark: SparkSession, path: str, schema) -> DataFrame:
    """The manifest's profile (of ``schema``) with the settings as one JSON column."""
    fields = StructType([*schema.fields, StructField("settings", StringType())])
    return spark.read.schema(fields).json(path)


def manifest_settings(spark: SparkSession, path: str) -> dict:
    """The settings of a stored manifest, as a later run needs them (one small object)."""
    row = spark.read.schema("settings string").json(path).first()
    return json.loads(row["settings"]) if row and row["settings"] else {}


def append_results(df: DataFrame, path: str) -> None:
    """Append result rows to a CSV folder with a header line per file."""
    df.write.mode("append").option("header", True).csv(path)


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def write_table(df: DataFrame, path: str, replace: bool = False) -> None:
    """Refuse to write over an existing target unless replacement is asked."""
    df.write.mode("overwrite" if replace else "errorifexists").parquet(path)
