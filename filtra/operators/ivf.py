"""Cluster-pruned approximate search: IVF build (R3) and probe search.

Build: MLlib KMeans over the vectors (all rows, or a seeded sample when a
fraction is given), every row stored with its nearest cell. Search: the
nprobe nearest cells of each query come from the block kernel run over the
centroid table; candidates are the rows of those cells only (an equi-join on
``cell``; on a cell-partitioned layout ``cell IN (probed)`` prunes files),
scored exactly.
With nprobe = nlist the result equals exact search.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filtra.config import OUTPUT_FIELDS
from filtra.functions.vectors import higher_is_nearer, score_expr
from filtra.operators.search import search_batch
from filtra.operators.topk import attach_fields, topk

# Centroid tables above this size (nlist x dim x 8 bytes) are refused: they
# are built on the driver by MLlib and broadcast for assignment.
MAX_CENTROID_BYTES = 512 << 20

# Probe rows are broadcast up to this size and joined by a shuffle beyond it.
MAX_PROBE_BROADCAST_BYTES = 256 << 20


def ivf_build(corpus: DataFrame, nlist: int, seed: int = 42, max_iter: int = 20,
              sample_fraction: float | None = None, vec_col: str = "embedding"):
    """Returns (index, centroids).

    index = corpus + ``cell`` (nearest centroid, squared L2);
    centroids = (cell int, center array<float>).
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    dim_row = corpus.select(F.max(F.size(vec_col)).alias("d")).first()
    dim = int(dim_row["d"] or 0)
    if nlist * dim * 8 > MAX_CENTROID_BYTES:
        raise ValueError(f"{nlist} centroids x {dim} dims exceed the centroid budget")
    from pyspark import StorageLevel
    feats = corpus.select(array_to_vector(F.col(vec_col)).alias("_f"))
    train = feats if not sample_fraction else feats.sample(False, sample_fraction, seed)
    # k-means reads its input once per iteration: keep the vectors materialised
    # (memory, spilling to disk) for the fit instead of re-deriving them.
    train = train.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        model = KMeans(k=nlist, seed=seed, maxIter=max_iter, featuresCol="_f",
                       predictionCol="cell").fit(train)
    finally:
        train.unpersist()
    index = model.transform(corpus.withColumn("_f", array_to_vector(F.col(vec_col)))) \
        .drop("_f").withColumn("cell", F.col("cell").cast("int"))
    spark = corpus.sparkSession
    centers = spark.createDataFrame(
        [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())],
        "cell int, center array<double>")
    centroids = centers.select("cell", F.col("center").cast("array<float>").alias("center"))
    return index, centroids


def centroids_count(centroids: DataFrame) -> int:
    return centroids.count()


def probe_cells(centroids: DataFrame, queries: DataFrame, nprobe: int,
                qvec_col: str = "q_dense") -> DataFrame:
    """(qid, cell): the nprobe centroids nearest (L2) to each query."""
    cent = centroids.select(F.col("cell").cast("long").alias("id"),
                            F.col("center").alias("embedding"))
    q = queries.select("qid", F.col(qvec_col).alias("q_dense"))
    hits = search_batch(cent, q, k=nprobe, metric="L2", fields=(), pred_fields=[])
    return hits.select("qid", F.col("id").cast("int").alias("cell"))


def ivf_search(index: DataFrame, centroids: DataFrame, queries: DataFrame, nprobe: int,
               k: int = 10, metric: str = "IP", fields: Sequence[str] = OUTPUT_FIELDS,
               pred_fields: Sequence[str] | None = None, qvec_col: str = "q_dense",
               vec_col: str = "embedding") -> DataFrame:
    """Qid, rank, id, score, *fields over the probed cells only.

    ``pred_fields`` present in ``queries`` restrict candidates (null = any)
    before ranking, as in exact search.
    """
    if pred_fields is None:
        pred_fields = [f for f in ("kbId", "study", "site", "patient", "visit")
                       if f in queries.columns]
    probes = probe_cells(centroids, queries, nprobe, qvec_col)
    size = queries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(qvec_col)).alias("d")).first()
    nq = size["n"]
    # every probe row carries its query vector
    probe_bytes = nq * nprobe * ((size["d"] or 0) * 8 + 256)
    qside = queries.select("qid", F.col(qvec_col).alias("_q"),
                           *[F.col(f).alias(f"_p_{f}") for f in pred_fields])
    plan = probes.join(qside, "qid")  # nq x nprobe rows
    side = F.broadcast(plan) if probe_bytes <= MAX_PROBE_BROADCAST_BYTES else plan
    cond = F.col("cell") == F.col("_pcell")
    for f in pred_fields:
        cond = cond & (F.col(f"_p_{f}").isNull() | (F.col(f) == F.col(f"_p_{f}")))
    side = side.withColumnRenamed("cell", "_pcell")
    # Static pruning: the probed cells (at most nlist values) become an IN
    # filter, so a cell-partitioned index is read only where probed.
    cells = sorted(r["cell"] for r in probes.select("cell").distinct().collect())
    cand = index.filter(F.col("cell").isin(cells)) if len(cells) < centroids_count(centroids) \
        else index
    cand = cand.select("id", "cell", vec_col, *pred_fields).join(side, cond, "inner")
    scored = cand.select("qid", "id", score_expr(metric, vec_col, "_q").alias("score"))
    best = topk(scored, k, keys=["qid"], higher=higher_is_nearer(metric))
    out = attach_fields(best, index, list(fields), max_hits=nq * k)
    return out.select("qid", "rank", "id", "score", *fields)


def ivf_search_widening(index: DataFrame, centroids: DataFrame, queries: DataFrame,
                        nprobe: int, k: int = 10, metric: str = "IP",
                        fields: Sequence[str] = OUTPUT_FIELDS,
                        pred_fields: Sequence[str] | None = None,
                        qvec_col: str = "q_dense") -> DataFrame:
    """R4 for selective filters: a query left with fewer than k hits is searched
    again with twice the probes, until it has k hits or every cell is probed.

    At most log2(nlist / nprobe) rounds; each round touches only the short
    queries and its result is checkpointed, so lineage does not grow.
    """
    from filtra.operators.sparse import persist_index
    nlist = centroids.count()
    p = max(1, min(int(nprobe), nlist))
    res = persist_index(ivf_search(index, centroids, queries, p, k, metric, fields,
                                   pred_fields, qvec_col))
    while p < nlist:
        counts = res.groupBy("qid").agg(F.count(F.lit(1)).alias("_n"))
        short = queries.join(counts, "qid", "left").filter(F.coalesce("_n", F.lit(0)) < k) \
            .drop("_n")
        if short.limit(1).count() == 0:
            break
        p = min(2 * p, nlist)
        again = ivf_search(index, centroids, short, p, k, metric, fields, pred_fields, qvec_col)
        kept = res.join(short.select("qid"), "qid", "left_anti")
        res = persist_index(kept.unionByName(again))
    return res


def write_ivf_index(index: DataFrame, path: str, mode: str = "errorifexists",
                    salt: int = 16) -> None:
    """Store an IVF index partitioned by ``cell``: a probe search then reads
    only the probed cells' files (``cell IN (probed cells)`` partition filter).
    A large cell is written by ``salt`` tasks."""
    out = index.repartition(F.col("cell"), F.pmod(F.xxhash64("id"), F.lit(salt)))
    out.sortWithinPartitions("cell", "id").write.mode(mode).partitionBy("cell").parquet(path)
