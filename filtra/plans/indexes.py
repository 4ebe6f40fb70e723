"""Indexes and layouts that are built once per data set and read by every search.

A registered query names the index it reads; the first one to do so in a
session builds and stores it in the shared folder, later ones only read it.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filtra.session import scratch_path

_BUILT = "_filtra_stored"


def stored_once(spark: SparkSession, sf_dir: str, name: str, write: Callable[[str], None]) -> str:
    """Path of the index ``name`` over ``sf_dir``; ``write(path)`` builds it on first use."""
    built = spark.__dict__.setdefault(_BUILT, {})
    key = (name, sf_dir.rstrip("/"))
    if key not in built:
        path = scratch_path(spark, name)
        start = time.perf_counter()
        write(path)
        built[key] = (path, time.perf_counter() - start)
    return built[key][0]


def build_seconds(spark: SparkSession) -> dict[str, float]:
    """Seconds each index of this session took to build."""
    return {name: round(s, 2) for (name, _), (_, s) in spark.__dict__.get(_BUILT, {}).items()}


COLUMNS = ("id", "kbId", "documentId", "embedding", "content", "study", "site", "patient", "visit")


def chunk_bytes(spark: SparkSession, sf_dir: str) -> float:
    """About the mean bytes of a row of the chunk views: measured on the two tables, before any join."""
    from filtra.sources.sinks import row_bytes
    from filtra.sources.tables import read_table
    mean = 0.0
    for name in ("documents", "embeddings"):
        df = read_table(spark, sf_dir, name)
        mean += df.agg(F.avg(row_bytes(df)).alias("b")).first()["b"] or 0.0
    return mean


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    from filtra.sources.sinks import write_clustered
    from filtra.sources.tables import texts_view

    def write(path: str) -> None:
        rows = texts_view(spark, sf_dir).withColumn("has_vector", F.col("embedding").isNotNull())
        write_clustered(rows, path, mean_bytes=chunk_bytes(spark, sf_dir))

    return spark.read.parquet(stored_once(spark, sf_dir, "corpus", write))


def stored_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its chunk columns, read from the clustered layout."""
    return _corpus(spark, sf_dir).select(*COLUMNS)


def stored_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that have a vector, read from the clustered layout."""
    return _corpus(spark, sf_dir).filter("has_vector").select(*COLUMNS)


def layout(spark: SparkSession, sf_dir: str, by: str) -> DataFrame:
    """The chunk table stored by kbId or by hash bucket."""
    from filtra.sources.sinks import read_corpus, write_corpus
    path = stored_once(spark, sf_dir, f"layout-{by}", lambda p: write_corpus(stored_chunks(spark, sf_dir), p, by=by))
    return read_corpus(spark, path)


def bucketed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunk table stored in buckets of documentId."""
    from filtra.sources.sinks import read_bucketed, write_bucketed
    path = stored_once(spark, sf_dir, "bucketed", lambda p: write_bucketed(
        stored_chunks(spark, sf_dir).drop("content"), p, "documentId"))
    return read_bucketed(spark, path)


def text_index(spark: SparkSession, sf_dir: str):
    """The segment index of all texts, with the five scalar fields beside each posting."""
    from filtra.config import SCALAR_FIELDS
    from filtra.operators.segments import TextIndex
    path = stored_once(spark, sf_dir, "text-index", lambda p: TextIndex(spark, p).append(
        stored_texts(spark, sf_dir), "0", keep=SCALAR_FIELDS))
    return TextIndex(spark, path)


def sparse_row_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, vec: the BM25 map of every text that has tokens."""
    from filtra.operators.sparse import sparse_rows
    path = stored_once(spark, sf_dir, "sparse-rows", lambda p: sparse_rows(
        text_index(spark, sf_dir).weights()).write.parquet(p))
    return spark.read.parquet(path)


def sparse_map_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posting blocks of the sparse map of every text."""
    from filtra.operators.impacts import posting_blocks, write_impacts
    path = stored_once(spark, sf_dir, "sparse-map-blocks",
                       lambda p: write_impacts(posting_blocks(sparse_texts(spark, sf_dir)), p))
    return spark.read.parquet(path)


def sparse_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its generated sparse map."""
    from filtra.sources.generator import sparse_vectors
    return stored_texts(spark, sf_dir).withColumn("sparse_embedding", sparse_vectors("id"))
