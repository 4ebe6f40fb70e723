"""Registered searches of many drawn queries (R2, R4), both sides distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filtra.config import TOP_K
from filtra.operators.blocked import cell_bounds, ivf_search_exact, search_blocked
from filtra.operators.ordering import row_index
from filtra.plans.catalog import group_queries, ivf_index, register
from filtra.plans.indexes import stored_chunks

# Queries of the concurrent workload. Query q takes its vector and its predicate from two stored
# rows, picked by the strides below; every fifty-first query leaves kbId open.
N_WORKLOAD = 10_000
VECTOR_STRIDE, PREDICATE_STRIDE, OPEN_EVERY = 7919, 104729, 51


def workload_queries(corpus: DataFrame, n: int = N_WORKLOAD) -> DataFrame:
    """qid, q_dense and a drawn five-field predicate (null: any value)."""
    spark = corpus.sparkSession
    rows = row_index(corpus.select("id", "kbId", "study", "site", "patient", "visit", "embedding"), [], ["id"], "at")
    total = rows.count()
    q = spark.range(n).select(F.col("id").alias("qid"))
    if not total:
        return q.filter("false").select("qid", F.lit(None).cast("array<float>").alias("q_dense"),
                                        *[F.lit(None).cast("string").alias(f) for f in
                                          ("kbId", "study", "site", "patient", "visit")])
    q = q.select("qid", (F.col("qid") * VECTOR_STRIDE % total + 1).alias("v"),
                 (F.col("qid") * PREDICATE_STRIDE % total + 1).alias("p"))
    vectors = rows.select(F.col("at").alias("v"), F.col("embedding").alias("q_dense"))
    values = rows.select(F.col("at").alias("p"), "kbId", "study", "site", "patient", "visit")
    drawn = q.join(vectors, "v").join(values, "p")

    def fixed(field: str, when) -> F.Column:
        return F.when(when, F.col(field)).alias(field)

    return drawn.select("qid", "q_dense", fixed("kbId", F.col("qid") % OPEN_EVERY != 0),
                        fixed("study", F.col("qid") % 2 == 1), fixed("site", F.col("qid") % 3 == 1),
                        fixed("patient", F.col("qid") % 7 == 3), fixed("visit", F.col("qid") % 11 == 5))


@register("workload_topk")
def workload_topk(spark, sf_dir):
    """R2: 10,000 drawn vectors and five-field predicates against the whole corpus in one pass."""
    c = stored_chunks(spark, sf_dir)
    return search_blocked(c, workload_queries(c), k=TOP_K)


@register("ivf_search_bounded")
def ivf_search_bounded(spark, sf_dir):
    """R4 that stops only when no unread cell can matter: equals exact search (batch_topk)."""
    c = stored_chunks(spark, sf_dir)
    index, cents = ivf_index(spark, sf_dir)
    hits, _ = ivf_search_exact(index, cell_bounds(index, cents), group_queries(c), k=TOP_K)
    return hits
