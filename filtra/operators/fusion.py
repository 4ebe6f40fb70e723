"""Rank fusion of retrieval arms: reciprocal rank (R7) and weighted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filtra.config import RRF_K
from filtra.functions.vectors import SCORE_SCALE
from filtra.operators.topk import topk


def rrf(arms: Sequence[DataFrame], k: int = 10, rrf_k: int = RRF_K,
        keys: Sequence[str] = ()) -> DataFrame:
    """score(id) = sum over arms that found id of 1 / (rrf_k + rank).

    Each arm is already cut to its own top-k with ranks from 1; an id found by
    one arm gets one term. Result: keys..., rank, id, score.
    """
    if not arms:
        raise ValueError("rrf needs at least one arm")
    u = None
    for a in arms:
        part = a.select(*keys, "id", "rank")
        u = part if u is None else u.unionByName(part)
    fused = u.groupBy(*keys, "id").agg(
        F.round(F.sum(F.lit(1.0) / (F.lit(float(rrf_k)) + F.col("rank"))), SCORE_SCALE)
        .alias("score"))
    return topk(fused, k, keys=list(keys)).select(*keys, "rank", "id", "score")


def weighted(arms: Sequence[tuple[DataFrame, float]], k: int = 10, norm: str = "none",
             keys: Sequence[str] = ()) -> DataFrame:
    """score(id) = sum of w_arm * arm score (0 for an arm that missed id).

    ``norm="minmax"`` rescales each arm's scores to [0, 1] per query first
    (a constant arm maps to 1). All arm scores must be higher-is-nearer.
    """
    if norm not in ("none", "minmax"):
        raise ValueError("norm must be 'none' or 'minmax'")
    u = None
    for i, (a, w) in enumerate(arms):
        s = F.col("score").cast("double")
        part = a.select(*keys, "id", s.alias("s"))
        if norm == "minmax":
            wk = Window.partitionBy(*keys) if keys else None
            lo = F.min("s").over(wk) if wk is not None else F.min("s").over(Window.partitionBy())
            hi = F.max("s").over(wk) if wk is not None else F.max("s").over(Window.partitionBy())
            part = part.withColumn("s", F.when(hi == lo, F.lit(1.0))
                                   .otherwise((F.col("s") - lo) / (hi - lo)))
        part = part.withColumn("s", F.col("s") * F.lit(float(w)))
        u = part if u is None else u.unionByName(part)
    fused = u.groupBy(*keys, "id").agg(F.round(F.sum("s"), SCORE_SCALE).alias("score"))
    return topk(fused, k, keys=list(keys)).select(*keys, "rank", "id", "score")
