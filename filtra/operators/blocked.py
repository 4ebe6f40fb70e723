"""Exact search for many queries, both sides distributed (R2), and cells with proven bounds.

Corpus rows and queries meet in co-groups: a group is one block of the rows that
can match (a slice of a KB, or of a cell) with the queries that want it. Inside a
group the block kernel multiplies the two matrices and keeps k rows per query;
a row_number per query merges the groups. Nothing of either side passes through
the driver, the corpus is shuffled once, and output fields travel with the hits.
"""

from __future__ import annotations

from collections.abc import Sequence
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filtra.config import OUTPUT_FIELDS, SCALAR_FIELDS
from filtra.functions.vectors import higher_is_nearer
from filtra.operators.bounded import bounded_search
from filtra.operators.ordering import row_index
from filtra.operators.search import block_kernel, kernel_payload
from filtra.operators.sparse import persist_index
from filtra.operators.topk import attach_fields, topk
from filtra.session import ship_package

BLOCK_BYTES = 32 << 20  # vectors of a corpus block
QUERY_BYTES = 32 << 20  # vectors of a block of queries


def _slice(n: Column | str, key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.greatest(F.col(n) if isinstance(n, str) else n, F.lit(1)))


def score_groups(rows: DataFrame, queries: DataFrame, k: int, metric: str, group: Sequence[str],
                 pred_fields: Sequence[str] = (), fields: Sequence[str] = (), vec_col: str = "embedding",
                 qvec_col: str = "q_dense") -> DataFrame:
    """qid, id, score, *fields: the k best rows of every (group, query).

    ``rows`` has the group columns, id, the vector and the fields; ``queries`` the group
    columns, qid, the vector and the predicate fields (null: any value). A group's rows and
    its queries must fit into a task; the callers cut them so.
    """
    ship_package(rows.sparkSession)
    pred_fields, fields, group = list(pred_fields), list(fields), list(group)
    kinds = {f: rows.schema[f].dataType.simpleString() for f in fields}
    out = ", ".join(["qid long", "id long", "score double", *[f"{f} {t}" for f, t in kinds.items()]])

    def empty(left: pa.Table) -> pa.Table:
        return pa.table({"qid": pa.array([], pa.int64()), "id": pa.array([], pa.int64()),
                         "score": pa.array([], pa.float64()),
                         **{f: left.column(f).slice(0, 0) for f in fields}})

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        # a query without a vector, or with one of another length, matches nothing
        size = pc.fill_null(pc.list_value_length(right.column("q")), 0)
        if not left.num_rows or not right.num_rows:
            return empty(left)
        found = []
        for dim in sorted({x for x in pc.unique(size).to_pylist() if x}):
            part = right.filter(pc.equal(size, dim))
            vectors = part.column("q").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            payload = kernel_payload(part.column("qid").to_numpy(), vectors.astype(np.float64).reshape(-1, dim),
                                     {f: part.column(f"_p_{f}").to_pylist() for f in pred_fields}, k, metric)
            kernel = block_kernel(SimpleNamespace(value=payload), vec_col, "id", pred_fields)
            found += list(kernel(iter(left.select(["id", vec_col, *pred_fields]).combine_chunks().to_batches())))
        if not found:
            return empty(left)
        hits = pa.Table.from_batches(found)
        at = pc.index_in(hits.column("id"), value_set=left.column("id").combine_chunks())
        return pa.table({**{c: hits.column(c) for c in ("qid", "id", "score")},
                         **{f: left.column(f).take(at) for f in fields}})

    keep = [c for c in dict.fromkeys([*pred_fields, *fields])]
    left = rows.select(*group, "id", vec_col, *keep)
    right = queries.select(*group, "qid", F.col(qvec_col).alias("q"),
                           *[F.col(f).alias(f"_p_{f}") for f in pred_fields])
    return left.groupBy(*group).cogroup(right.groupBy(*group)).applyInArrow(run, out)


def _blocks_of(rows: DataFrame, key: Column, vec_col: str) -> DataFrame:
    """kb, n: into how many blocks the rows of a key are cut, by their vectors' bytes."""
    size = F.sum(F.greatest(F.size(vec_col), F.lit(0)).cast("long") * 8 + 64)
    return rows.groupBy(key.alias("kb")).agg(F.ceil(size / F.lit(BLOCK_BYTES)).cast("long").alias("n"))


def _only(cuts: DataFrame) -> int:
    row = cuts.first()
    return int(row["n"]) if row else 1


def search_blocked(corpus: DataFrame, queries: DataFrame, k: int = 10, metric: str = "IP",
                   fields: Sequence[str] = OUTPUT_FIELDS, pred_fields: Sequence[str] | None = None,
                   key: str = "kbId", qvec_col: str = "q_dense", vec_col: str = "embedding") -> DataFrame:
    """R2: qid, rank, id, score, *fields for every row of ``queries``; equals ``search_batch``.

    Queries that fix ``key`` meet that key's blocks only; queries that leave it open meet every
    block. A key that holds much of the corpus has many blocks, a key that many queries want
    has many blocks of queries.
    """
    if pred_fields is None:
        pred_fields = [f for f in SCALAR_FIELDS if f in queries.columns]
    pred_fields = list(pred_fields)
    # the key as a hash, so that null keys are a group too; equality itself is checked by the kernel
    own = F.xxhash64(key) if key in pred_fields else F.lit(0).cast("long")
    cuts = persist_index(_blocks_of(corpus, own, vec_col))  # one row per key
    rows = corpus.withColumn("kb", own)
    # one row per key, and none without rows
    rows = (rows.join(cuts, "kb") if key in pred_fields else rows.withColumn("n", F.lit(_only(cuts)))
            ).withColumn("blk", _slice("n", "id"))
    q = queries.select("qid", F.col(qvec_col).alias("q_dense"), *pred_fields)
    is_open = F.col(key).isNull() if key in pred_fields else F.lit(True)
    size = q.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("q_dense")).alias("d"),
                 F.count_if(is_open).alias("open")).first()
    units = cuts.select("kb", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n"), F.lit(1)) - 1)).alias("blk"))
    wanted = None
    if key in pred_fields:
        wanted = q.filter(~is_open).withColumn("kb", own).join(units, "kb")
    if size["open"] or wanted is None:
        # a query open in the key wants every block, by the blocks' numbers
        numbered = persist_index(row_index(units, [], ["kb", "blk"], "unit"))
        numbers = F.expr(f"sequence(1L, {max(numbered.count(), 1)}L)")
        anywhere = (q.filter(is_open).withColumn("unit", F.explode(numbers)).join(numbered, "unit")
                    .select(*q.columns, "kb", "blk"))
        wanted = anywhere if wanted is None else wanted.select(*q.columns, "kb", "blk").unionByName(anywhere)
    parts = max(1, -(-int(size["n"]) * (int(size["d"] or 0) * 8 + 256) // QUERY_BYTES))
    group = ["kb", "blk"]
    if parts > 1:
        # blocks of queries: the corpus block is met by each of them
        group.append("qb")
        wanted = wanted.withColumn("qb", F.pmod(F.xxhash64("qid"), F.lit(parts)).cast("int"))
        rows = rows.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    found = score_groups(rows, wanted, k, metric, group, pred_fields, fields, vec_col)
    best = topk(found, k, keys=["qid"], higher=higher_is_nearer(metric))
    return best.select("qid", "rank", "id", "score", *fields)


# --------------------------------------------------------------------- R4

def cell_bounds(index: DataFrame, centroids: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """cell, center, rows, radius, min_norm, max_norm of every cell that has rows.

    ``radius`` is the largest distance of a row from its centre: what no row of the cell exceeds.
    """
    c = centroids.select("cell", F.col("center").cast("array<double>").alias("center"))
    far = F.sqrt(F.aggregate(F.zip_with(vec_col, "center", lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)),
                             F.lit(0.0), lambda a, x: a + x))
    norm = F.sqrt(F.aggregate(F.transform(vec_col, lambda x: x.cast("double") * x.cast("double")),
                              F.lit(0.0), lambda a, x: a + x))
    return (index.select("cell", vec_col).join(c, "cell")
            .groupBy("cell").agg(F.count(F.lit(1)).alias("rows"), F.max(far).alias("radius"),
                                 F.min(norm).alias("min_norm"), F.max(norm).alias("max_norm"))
            .join(c, "cell"))


def _query_cell_bounds(cells: DataFrame, queries: DataFrame, metric: str) -> DataFrame:
    """qid, cell, bound: the best score that a row of the cell can have for the query."""
    spark = cells.sparkSession
    n = max(1, cells.count())
    c = cells.select(F.col("cell").cast("long").alias("id"), F.col("center").alias("embedding"),
                     "radius", "min_norm", "max_norm")
    what = "L2" if metric == "L2" else "IP"
    near = search_blocked(c, queries.select("qid", "q_dense"), k=n, metric=what,
                          fields=("radius", "min_norm", "max_norm"), pred_fields=())
    norm = F.sqrt(F.aggregate(F.transform("q_dense", lambda x: x.cast("double") * x.cast("double")),
                              F.lit(0.0), lambda a, x: a + x))
    q = queries.select("qid", norm.alias("qn"))
    ship_package(spark)
    reach = F.col("score") + F.col("qn") * F.col("radius")  # q.c + |q| r, or the distance to the centre
    if metric == "L2":
        bound = F.greatest(F.lit(0.0), F.col("score") - F.col("radius"))
    elif metric == "IP":
        bound = reach
    else:
        # cosine: the inner product's bound over the norm that makes it largest; 1 at most
        norm_of = F.when(reach >= 0, F.col("min_norm")).otherwise(F.col("max_norm"))
        bound = F.when((norm_of == 0) | (F.col("qn") == 0), F.lit(1.0)).otherwise(
            F.least(F.lit(1.0), reach / (F.col("qn") * norm_of)))
        # rows of norm 0 score 0
        bound = F.when(F.col("min_norm") == 0, F.greatest(bound, F.lit(0.0))).otherwise(bound)
    return near.join(q, "qid").select("qid", F.col("id").cast("int").alias("cell"), bound.alias("bound"))


def ivf_search_exact(index: DataFrame, cells: DataFrame, queries: DataFrame, k: int = 10, metric: str = "IP",
                     fields: Sequence[str] = OUTPUT_FIELDS, pred_fields: Sequence[str] | None = None,
                     first: int = 2, vec_col: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """R4 with a guarantee: (hits, reads); the hits equal exact search.

    Cells are probed in the order of their bounds, in rounds of doubling size, until the next
    cell's bound is below the k-th score. ``cells`` comes from :func:`cell_bounds`; ``reads`` has
    the cells read per query. Filters apply before ranking, as in exact search.
    """
    metric = metric.upper()
    if pred_fields is None:
        pred_fields = [f for f in SCALAR_FIELDS if f in queries.columns]
    pred_fields = list(pred_fields)
    # bounds are compared with rounded scores of rounded centres: one part in a million each
    bounds = persist_index(_query_cell_bounds(cells, queries, metric))
    size = F.ceil(F.col("rows") * (F.size("center").cast("long") * 8 + 64) / F.lit(BLOCK_BYTES)).cast("long")
    cuts = persist_index(cells.select("cell", size.alias("n")))
    rows = index.select("id", "cell", vec_col, *pred_fields).join(cuts, "cell").withColumn("blk", _slice("n", "id"))

    def score(need: DataFrame) -> DataFrame:
        wanted = (need.join(queries.select("qid", "q_dense", *pred_fields), "qid").join(cuts, "cell")
                  .withColumn("blk", F.explode(F.sequence(F.lit(0).cast("long"),
                                                          F.greatest(F.col("n"), F.lit(1)) - 1))))
        # only probed cells are read: at most as many values as there are cells
        probed = [r["cell"] for r in need.select("cell").distinct().collect()]
        return score_groups(rows.filter(F.col("cell").isin(probed)), wanted, k, metric, ["cell", "blk"],
                            pred_fields, (), vec_col)

    slack = 4e-6
    hits, reads = bounded_search(bounds, score, k, ["cell"], first, higher_is_nearer(metric), slack)
    out = attach_fields(hits, index, list(fields)).select("qid", "rank", "id", "score", *fields)
    return out, reads.withColumnsRenamed({"units_read": "cells_read", "units_total": "cells_total"})
