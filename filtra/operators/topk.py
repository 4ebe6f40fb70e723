"""Top-k building blocks shared by dense, sparse and fused search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_order(score_col: str = "score", higher: bool = True, id_col: str = "id") -> list[Column]:
    s = F.col(score_col)
    return [s.desc_nulls_last() if higher else s.asc_nulls_last(), F.col(id_col).asc()]


def topk(df: DataFrame, k: int, keys: Sequence[str] = (), score_col: str = "score",
         higher: bool = True, id_col: str = "id", rank_col: str = "rank") -> DataFrame:
    """Keep the k best rows per ``keys`` (all rows when ``keys`` is empty).

    With keys: ``row_number() <= k`` -- Catalyst inserts a partial
    WindowGroupLimit before the shuffle, so at most k rows per key leave each
    map task. Without keys: ``orderBy().limit()`` -> TakeOrderedAndProject,
    again k rows per task; the final k-row result is ranked in place.
    """
    if k < 0:
        raise ValueError("k must be >= 0")
    order = rank_order(score_col, higher, id_col)
    if keys:
        w = Window.partitionBy(*keys).orderBy(*order)
        return (df.withColumn(rank_col, F.row_number().over(w).cast("long"))
                .filter(F.col(rank_col) <= k))
    top = df.orderBy(*order).limit(k)
    # k rows at most: numbering them needs no partitioning.
    return top.withColumn(rank_col, F.row_number().over(Window.orderBy(*order)).cast("long"))


def attach_fields(hits: DataFrame, corpus: DataFrame, fields: Sequence[str],
                  id_col: str = "id", max_hits: int | None = None) -> DataFrame:
    """Late materialisation (F12): fetch output fields for ranked hits by id.

    ``hits`` is at most (queries x k) rows; when the caller knows that bound
    (``max_hits``) and it is under the broadcast limit the hits are broadcast
    and the corpus is streamed once with only ``id`` + ``fields`` read.
    Otherwise the join is left to the planner (AQE can still switch it to a
    broadcast once the real size is known).
    """
    if not fields:
        return hits
    side = corpus.select(id_col, *fields)
    if max_hits is not None and max_hits <= 1_000_000:
        return side.join(F.broadcast(hits), id_col, "inner")
    return hits.join(side, id_col, "inner")
