"""Dense filtered top-k search (R1 single query, R2 many queries).

R1 is a pure expression plan: filter -> score -> TakeOrderedAndProject.
R2 scores a batch of queries, each with its own predicate, with a block
kernel: the query matrix is broadcast (after a size check), every Arrow batch
of the corpus is multiplied by it once, and each task keeps only the k best
rows per query. Only (qid, id, score) rows leave the tasks -- never the vectors
and never all (query, chunk) pairs. A final per-qid ``row_number`` merges them.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filtra.config import OUTPUT_FIELDS, SCALAR_FIELDS
from filtra.functions.vectors import SCORE_SCALE, higher_is_nearer, score_expr, vector_literal
from filtra.operators.topk import attach_fields, topk
from filtra.session import ship_package

# Broadcast budget for the query side of R2 (bytes). Above it the queries are
# split into slices that each fit, and the slices are searched one by one.
MAX_QUERY_BROADCAST_BYTES = 64 << 20
# Rows scored per kernel step: (rows x dim) and (queries x rows) matrices stay
# small (2048 x 3072 doubles = 50 MB) even if Arrow batches are larger.
KERNEL_ROWS = 2048
# Work arrays of the kernel hold at most so many (query, row) cells.
KERNEL_CELLS = 1 << 22
# Longest IN list derived from a batch's predicates for pruning the scan.
MAX_LITERAL_IN = 1000


# Above this dimension R1 scores with the block kernel: one matrix product per
# Arrow batch beats a per-row zip_with/aggregate over thousands of elements. The
# results are the same: scores are exact and rounded half up either way.
KERNEL_MIN_DIM = 256


def search(corpus: DataFrame, query, where: Column | None = None, k: int = 10,
           metric: str = "IP", fields: Sequence[str] = OUTPUT_FIELDS,
           vec_col: str = "embedding", id_col: str = "id",
           semi: tuple[DataFrame, str] | None = None, method: str = "auto") -> DataFrame:
    """Filtered exact top-k for one query vector.

    ``query`` is a sequence of floats (bound as one foldable literal) or an
    array column. ``where`` is applied before scoring and reaches the scan;
    ``semi`` = (keys_df, column) restricts to keys in a DataFrame (long IN
    lists). ``method``: "expr" (codegen'd expression, TakeOrderedAndProject),
    "kernel" (Arrow block kernel), or "auto" (kernel above KERNEL_MIN_DIM
    dimensions). Result: rank, id, score, *fields.
    """
    if method not in ("auto", "expr", "kernel"):
        raise ValueError("method must be auto, expr or kernel")
    df = corpus
    if where is not None:
        df = df.filter(where)
    if semi is not None:
        keys_df, key = semi
        df = df.join(keys_df.select(key).distinct(), key, "left_semi")
    if isinstance(query, Column):
        method = "expr" if method == "auto" else method
    elif method == "auto":
        method = "kernel" if len(query) > KERNEL_MIN_DIM else "expr"
    if method == "kernel":
        if isinstance(query, Column):
            raise ValueError("the kernel needs the query vector as values")
        spark = corpus.sparkSession
        qs = spark.createDataFrame([(0, [float(x) for x in query])], "qid long, q_dense array<double>")
        res = search_batch(df, qs, k=k, metric=metric, fields=fields, pred_fields=[],
                           vec_col=vec_col, id_col=id_col)
        return res.select("rank", "id", "score", *fields)
    q = query if isinstance(query, Column) else vector_literal(query)
    scored = df.filter(F.size(vec_col) == F.size(q)).select(
        F.col(id_col).alias("id"), *fields, score_expr(metric, vec_col, q).alias("score"))
    top = topk(scored, k, higher=higher_is_nearer(metric))
    return top.select("rank", "id", "score", *fields)


def round_half_up(x: np.ndarray, scale: int = SCORE_SCALE) -> np.ndarray:
    """Rounding of the score expressions: halves away from zero."""
    unit = 10.0 ** scale
    return np.copysign(np.floor(np.abs(x) * unit + 0.5) / unit, x)


def exact_l2(rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """(rows x queries) Euclidean distances from the differences themselves: the expansion
    |b|^2 - 2 b q + |q|^2 cancels for near copies."""
    out = np.empty((len(rows), len(queries)))
    for i, q in enumerate(queries):
        d = rows - q
        out[:, i] = np.sqrt(np.einsum("nd,nd->n", d, d))
    return out


# --------------------------------------------------------------------------- R2

def block_kernel(payload_bc, vec_col: str, id_col: str, pred_fields: list[str]):
    """Per-partition scorer: keeps the k best rows per query over all batches."""

    def kernel(batches):
        p = payload_bc.value
        Q = p["Q"]
        nq, dim = Q.shape
        k = p["k"]
        metric = p["metric"]
        higher = metric != "L2"
        qnorm = np.sqrt((Q * Q).sum(axis=1))
        best_key = np.full((nq, k), -np.inf)
        best_id = np.full((nq, k), np.iinfo(np.int64).max, dtype=np.int64)
        best_score = np.zeros((nq, k))
        step = p["step"]

        def slices(it):
            # bound the per-step matrices whatever the session's Arrow batch size
            for big in it:
                for off in range(0, big.num_rows, step):
                    yield big.slice(off, step)

        for rb in slices(batches):
            n = rb.num_rows
            if n == 0 or k == 0:
                continue
            ids = rb.column(id_col).to_numpy(zero_copy_only=False).astype(np.int64)
            vecs = rb.column(vec_col)
            lens = vecs.value_lengths().to_numpy(zero_copy_only=False)
            ok = (np.nan_to_num(lens.astype(float), nan=-1) == dim)
            if vecs.null_count:
                ok &= ~vecs.is_null().to_numpy(zero_copy_only=False)
            B = np.zeros((n, dim))
            if ok.any():
                flat = vecs.filter(pa.array(ok)).flatten().to_numpy(zero_copy_only=False)
                B[ok] = flat.astype(np.float64).reshape(-1, dim)
            S = exact_l2(B, Q) if metric == "L2" else B @ Q.T  # (n, nq)
            if metric == "COSINE":
                bn = np.sqrt((B * B).sum(axis=1))
                den = bn[:, None] * qnorm[None, :]
                S = np.where(den == 0, 0.0, S / np.where(den == 0, 1.0, den))
            S = round_half_up(S).T  # (nq, n)
            mask = np.broadcast_to(ok[None, :], (nq, n)).copy()
            for f in pred_fields:
                # codes of the batch's values in the queries' value set (-1: none)
                vals = p["pred_values"][f]
                cc = pc.index_in(rb.column(f), value_set=vals).fill_null(-1)
                cc = cc.to_numpy(zero_copy_only=False).astype(np.int64)
                qc = p["pred_codes"][f]  # -2 = wildcard
                mask &= (qc[:, None] == cc[None, :]) | (qc[:, None] == -2)
            key = np.where(mask, S if higher else -S, -np.inf)
            take = min(k, n)
            # candidates: every matching row at or above the query's k-th best
            # key (ties included) -- a linear-time partition instead of a sort
            if n > take:
                kth = np.partition(key, n - take, axis=1)[:, n - take]
                sel_m = (key >= kth[:, None]) & mask
            else:
                sel_m = mask
            r, c = np.nonzero(sel_m)
            o = np.lexsort((ids[c], -key[r, c], r))
            r, c = r[o], c[o]
            pos = np.arange(r.size) - np.searchsorted(r, r)
            keep = pos < take
            r, c, pos = r[keep], c[keep], pos[keep]
            new_key = np.full((nq, take), -np.inf)
            new_id = np.full((nq, take), np.iinfo(np.int64).max, dtype=np.int64)
            new_score = np.zeros((nq, take))
            new_key[r, pos] = key[r, c]
            new_id[r, pos] = ids[c]
            new_score[r, pos] = S[r, c]
            cand_key = np.concatenate([best_key, new_key], axis=1)
            cand_id = np.concatenate([best_id, new_id], axis=1)
            cand_score = np.concatenate([best_score, new_score], axis=1)
            sel = np.lexsort((cand_id, -cand_key), axis=-1)[:, :k]
            best_key = np.take_along_axis(cand_key, sel, 1)
            best_id = np.take_along_axis(cand_id, sel, 1)
            best_score = np.take_along_axis(cand_score, sel, 1)
        keep = np.isfinite(best_key)
        qi, _ = np.nonzero(keep)
        if qi.size:
            yield pa.RecordBatch.from_arrays(
                [pa.array(p["qids"][qi], pa.int64()), pa.array(best_id[keep], pa.int64()),
                 pa.array(best_score[keep], pa.float64())],
                names=["qid", "id", "score"])

    return kernel


def kernel_payload(qids, vectors, preds: dict, k: int, metric: str) -> dict:
    """What the kernel needs of a block of queries: vectors, and predicate values as codes."""
    n = len(qids)
    Q = np.array(vectors, dtype=np.float64).reshape(n, -1)
    pred_values, pred_codes = {}, {}
    for f, vs in preds.items():
        uniq = sorted({v for v in vs if v is not None}, key=repr)
        pos = {v: i for i, v in enumerate(uniq)}
        pred_values[f] = pa.array(uniq) if uniq else pa.array([], pa.string())
        pred_codes[f] = np.array([pos[v] if v is not None else -2 for v in vs], dtype=np.int64)
    return {
        "Q": Q, "k": int(k), "metric": metric.upper(),
        "step": max(1, min(int(KERNEL_ROWS), KERNEL_CELLS // max(n, 1))),
        "qids": np.array(qids, dtype=np.int64),
        "preds": preds, "pred_values": pred_values, "pred_codes": pred_codes,
    }


def _search_slice(corpus, qrows, k, metric, vec_col, id_col, pred_fields):
    spark = corpus.sparkSession
    ship_package(spark)
    payload = kernel_payload([r["qid"] for r in qrows], [r["q"] for r in qrows],
                             {f: [r[f] for r in qrows] for f in pred_fields}, k, metric)
    # Static pruning: when every query fixes a field, only rows holding one of
    # those values can match; the IN list reaches the scan (and partition
    # pruning on a layout partitioned by that field).
    df = corpus
    for f in pred_fields:
        vals = payload["preds"][f]
        if vals and all(v is not None for v in vals) and len(set(vals)) <= MAX_LITERAL_IN:
            df = df.filter(F.col(f).isin(sorted(set(vals))))
    cols = [id_col, vec_col, *pred_fields]
    bc = spark.sparkContext.broadcast(payload)
    kern = block_kernel(bc, vec_col, id_col, pred_fields)
    return df.select(*cols).mapInArrow(kern, "qid long, id long, score double")


def search_batch(corpus: DataFrame, queries: DataFrame, k: int = 10, metric: str = "IP",
                 fields: Sequence[str] = OUTPUT_FIELDS,
                 pred_fields: Sequence[str] | None = None,
                 qid_col: str = "qid", qvec_col: str = "q_dense", vec_col: str = "embedding",
                 id_col: str = "id",
                 max_query_bytes: int = MAX_QUERY_BROADCAST_BYTES) -> DataFrame:
    """R2: exact filtered top-k for every row of ``queries``.

    ``queries`` holds ``qid``, the query vector and, per field in
    ``pred_fields`` (default: the scalar fields present), a predicate value
    where null means "not restricted". Result: qid, rank, id, score, *fields.
    """
    if pred_fields is None:
        pred_fields = [f for f in SCALAR_FIELDS if f in queries.columns]
    pred_fields = list(pred_fields)
    qcols = [F.col(qid_col).alias("qid"), F.col(qvec_col).alias("q"), *pred_fields]
    # The query table is small but may be derived from the corpus: keep it for
    # the two actions below (size check, then the bounded collect).
    qdf = queries.select(*qcols).persist(StorageLevel.MEMORY_AND_DISK)
    stats = qdf.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("q")).alias("d")).first()
    nq, dim = int(stats["n"]), int(stats["d"] or 0)
    empty = corpus.sparkSession.createDataFrame([], "qid long, id long, score double")
    if nq == 0:
        parts = [empty]
    else:
        per_query = dim * 8 + 256 * (len(pred_fields) + 1)
        n_slices = max(1, math.ceil(nq * per_query / max_query_bytes))
        parts = []
        for s in range(n_slices):
            sl = qdf if n_slices == 1 else qdf.filter(
                F.pmod(F.xxhash64("qid"), F.lit(n_slices)) == s)
            # bounded by the size check above: at most max_query_bytes per slice
            qrows = [r.asDict() for r in sl.collect()]
            if qrows:
                parts.append(_search_slice(corpus, qrows, k, metric, vec_col, id_col,
                                           pred_fields))
    qdf.unpersist()
    cand = parts[0]
    for p in parts[1:]:
        cand = cand.unionByName(p)
    best = topk(cand, k, keys=["qid"], higher=higher_is_nearer(metric))
    out = attach_fields(best, corpus.withColumnRenamed(id_col, "id") if id_col != "id" else corpus,
                        list(fields), max_hits=nq * k)
    return out.select("qid", "rank", "id", "score", *fields)
