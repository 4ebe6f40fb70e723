"""Result-quality analytics: recall@k (R10), ranker overlap (R11),
chunk hits rolled up to documents (R12)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def recall_at_k(exact: DataFrame, other: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per key: k (exact list size), found, recall = found / k; exact rows kept
    by a left join so a query whose list shares nothing still reports 0."""
    e = exact.select(*keys, "id")
    o = other.select(*keys, "id").withColumn("_hit", F.lit(1))
    j = e.join(o, [*keys, "id"], "left")
    agg = j.groupBy(*keys).agg(F.count(F.lit(1)).alias("k"),
                               F.count("_hit").alias("found"))
    return agg.withColumn("recall", F.round(F.col("found") / F.col("k"), 6))


def overlap(left: DataFrame, right: DataFrame, label: str,
            keys: Sequence[str] = ()) -> DataFrame:
    """label, shared = |L and R|, only_left = |L - R|, only_right = |R - L|, jaccard.

    One full outer join on (keys, id) and one aggregate: the set algebra of
    INTERSECT / EXCEPT without three separate shuffles.
    """
    lk = left.select(*keys, "id").distinct().withColumn("_l", F.lit(1))
    rk = right.select(*keys, "id").distinct().withColumn("_r", F.lit(1))
    j = lk.join(rk, [*keys, "id"], "full")
    both = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    agg = j.groupBy(*keys).agg(
        F.count(F.when(both, 1)).alias("shared"),
        F.count(F.when(F.col("_r").isNull(), 1)).alias("only_left"),
        F.count(F.when(F.col("_l").isNull(), 1)).alias("only_right"),
    )
    total = F.col("shared") + F.col("only_left") + F.col("only_right")
    return agg.select(
        F.lit(label).alias("pair"), *keys, "shared", "only_left", "only_right",
        F.round(F.when(total == 0, F.lit(0.0)).otherwise(F.col("shared") / total), 6)
        .alias("jaccard"))


def chunk_hits_by_document(chunks: DataFrame, doc_ids: DataFrame,
                           doc_col: str = "documentId") -> DataFrame:
    """Chunks matched per document for an IN list given as a DataFrame."""
    hits = chunks.join(doc_ids.select(doc_col).distinct(), doc_col, "left_semi")
    return hits.groupBy(doc_col).agg(F.count(F.lit(1)).alias("chunks"))
