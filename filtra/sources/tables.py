"""Readers for the driver tables and the views the retrieval workload runs on.

The views (FIXTURES.md) map the driver's parquet tables onto the chunk schema
so that the same rows can be checked against a SQL oracle:

* ``chunks``      embeddings joined to documents, one chunk per document
* ``texts``       the same for every document, with or without an embedding
* ``request_log`` per-request latency samples, from ``events``
* ``event_log``   creation-study event rows, from ``events``
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filtra.operators.ordering import row_index

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")

# Fixed value: the stored row whose attributes and vectors parameterise the
# single-query workloads (FIXTURES.md section 2).
ANCHOR_ID = 7


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _pad(c: Column, n: int) -> Column:
    return F.lpad(c.cast("string"), n, "0")


def chunks_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, kbId, documentId, embedding, content, study, site, patient, visit."""
    e = read_table(spark, sf_dir, "embeddings")
    d = read_table(spark, sf_dir, "documents")
    return _chunk_columns(e.join(d, e.vec_id == d.doc_id, "inner"), "vec_id")


def texts_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of ``chunks_view`` for every document; kbId and embedding are
    null where the document has no embedding."""
    e = read_table(spark, sf_dir, "embeddings")
    d = read_table(spark, sf_dir, "documents")
    return _chunk_columns(d.join(e, e.vec_id == d.doc_id, "left"), "doc_id")


def _chunk_columns(j: DataFrame, id_col: str) -> DataFrame:
    return j.select(
        F.col(id_col).alias("id"),
        F.concat(F.lit("kb_"), _pad(F.col("label"), 2)).alias("kbId"),
        F.concat(F.lit("doc_"), _pad(F.col("doc_id") + 1, 8)).alias("documentId"),
        F.col("embedding"),
        F.col("text").alias("content"),
        F.concat(F.lit("S"), _pad(F.substring(F.col("source"), 4, 1 << 20), 3)).alias("study"),
        F.concat(F.lit("SITE_"), F.upper(F.col("lang"))).alias("site"),
        F.concat(F.lit("P"), _pad(F.col("n_chars") % 30, 5)).alias("patient"),
        F.concat(F.lit("V"), _pad(F.col("doc_id") % 30, 2)).alias("visit"),
    )


def anchor_row(corpus: DataFrame, fields=("kbId", "study", "site", "patient", "visit",
                                          "documentId", "embedding"),
               anchor_id: int = ANCHOR_ID):
    """Parameter binding: the attribute values and vector of one stored row.

    One row by primary key; this is how a client supplies a query vector and
    predicate values, not a pass of data through the driver.
    """
    row = corpus.filter(F.col("id") == anchor_id).select(*fields).first()
    if row is None:
        raise ValueError(f"anchor row id={anchor_id} not in corpus")
    return row.asDict()


def ntz_as_utc(spark: SparkSession, col: str) -> Column:
    """TIMESTAMP_NTZ wall-clock values read as UTC instants, whatever the
    session time zone (``withWatermark`` needs TIMESTAMP, not NTZ)."""
    tz = spark.conf.get("spark.sql.session.timeZone")
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), F.col(col)).cast("timestamp")


def request_log_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """request_id, ts, query, plan, concurrency, latency_ms."""
    ev = read_table(spark, sf_dir, "events")
    conc = (F.when(F.col("user_id") % 4 == 0, 1).when(F.col("user_id") % 4 == 1, 4)
            .when(F.col("user_id") % 4 == 2, 16).otherwise(32))
    return ev.select(
        F.col("event_id").alias("request_id"),
        ntz_as_utc(spark, "ts").alias("ts"),
        F.col("event_type").alias("query"),
        F.when(F.col("user_id") % 2 == 0, "plain").otherwise("partitioned").alias("plan"),
        conc.cast("int").alias("concurrency"),
        F.col("value").alias("latency_ms"),
    )


def event_log_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """phase, iteration, event, create_ms, list_ms, error, elapsed_s, ts."""
    ev = read_table(spark, sf_dir, "events")
    ts = ntz_as_utc(spark, "ts")
    # four phases a month, counted from the log's first month
    month = F.year("ts") * 12 + F.month("ts")
    first = ev.agg(F.min(month).alias("m")).first()["m"] or 0
    base = ev.select(
        (F.lit(1) + (month - F.lit(first)) * 4 + F.floor((F.dayofmonth(F.col("ts")) - 1) / 8)).cast("int")
        .alias("phase"),
        ts.alias("ts"), "event_id",
        F.when(F.col("event_type") == "error", "create_failed").otherwise("sample").alias("event"),
        F.col("value").alias("create_ms"),
        F.get_json_object("props", "$.k").cast("double").alias("list_ms"),
        F.when(F.col("event_type") == "error",
               F.concat(F.lit("code="), F.col("user_id").cast("string"))).otherwise(F.lit(""))
        .alias("error"),
    )
    # iteration = row_number() over (partition by phase order by ts, event_id),
    # computed without funnelling a whole phase through one task.
    indexed = row_index(base, ["phase"], ["ts", "event_id"], "iteration")
    # phase start: an aggregate with four rows a month of log, joined back instead
    # of a whole-phase window.
    starts = base.groupBy("phase").agg(F.min("ts").alias("_t0"))
    return (indexed.join(F.broadcast(starts), "phase")
            .withColumn("elapsed_s",
                        (F.unix_micros(F.col("ts")) - F.unix_micros(F.col("_t0"))) / F.lit(1e6))
            .drop("_t0"))
