"""Approximate nearest neighbours by robust-pruned directed graphs (operator 4).

Equal vectors are collapsed to one node. The distinct vectors are dealt into
shards of a bounded size; every shard builds a directed graph in which greedy
searches propose neighbours and relaxed distance pruning keeps diverse edges.
A query runs a beam search in every shard, and the best of all shards are
ranked by the exact measure. Inner products become distances by one more
coordinate that gives all vectors of a shard the same length.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filtra.llm.common import cut, ship_package, table

K = 20
SHARD_ROWS = 8192  # expected distinct vectors per shard
DEGREE = 28
BUILD_BEAM = 48
SEARCH_BEAM = 72
ALPHA = 1.2  # relaxation of the pruning rule, applied to distances
BUILD_BATCH = 256
QUERY_BLOCK = 512  # queries searched together in a shard
SEED = 5


def _sq(x: np.ndarray, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distances of x[rows] (n, m) to q (n, d)."""
    v = x[rows]
    return np.maximum(np.einsum("nmd,nmd->nm", v, v) - 2 * np.einsum("nmd,nd->nm", v, q)
                      + np.einsum("nd,nd->n", q, q)[:, None], 0)


def beam_search(x: np.ndarray, graph: np.ndarray, start: np.ndarray, queries: np.ndarray, beam: int):
    """Greedy beam search of many queries at once.

    Returns (ids, dists) of the final beams, nearest first, -1 where short. In
    every step each query expands its nearest unexpanded node.
    """
    n, q = len(x), len(queries)
    rows = np.arange(q)
    ids = np.full((q, beam), -1, dtype=np.int64)
    dist = np.full((q, beam), np.inf, dtype=np.float32)
    open_ = np.zeros((q, beam), dtype=bool)
    seen = np.zeros((q, n), dtype=bool)
    s = np.broadcast_to(start, (q, len(start)))
    ds = _sq(x, s, queries)
    m = min(beam, s.shape[1])
    order = np.argsort(ds, axis=1)[:, :m]
    ids[:, :m] = np.take_along_axis(s, order, 1)
    dist[:, :m] = np.take_along_axis(ds, order, 1)
    open_[:, :m] = True
    seen[rows[:, None], s] = True
    active = rows
    while len(active):
        first = open_[active].argmax(axis=1)
        more = open_[active, first]
        active, first = active[more], first[more]
        if not len(active):
            break
        open_[active, first] = False
        near = graph[ids[active, first]]
        ok = near >= 0
        safe = np.where(ok, near, 0)
        ok &= ~seen[active[:, None], safe]
        seen[active[:, None], safe] |= ok
        d = np.where(ok, _sq(x, safe, queries[active]), np.inf).astype(np.float32)
        all_d = np.concatenate([dist[active], d], axis=1)
        all_i = np.concatenate([ids[active], np.where(ok, near, -1)], axis=1)
        all_o = np.concatenate([open_[active], ok], axis=1)
        best = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
        dist[active] = np.take_along_axis(all_d, best, 1)
        ids[active] = np.take_along_axis(all_i, best, 1)
        open_[active] = np.take_along_axis(all_o, best, 1)
    return ids, dist


def robust_prune(x: np.ndarray, nodes: np.ndarray, cand: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Keep diverse neighbours: the nearest candidate stays and drops every other
    that it is ``alpha`` times nearer to than the node itself. cand: (n, m), -1 none."""
    n, m = cand.shape
    ok = (cand >= 0) & (cand != nodes[:, None])
    safe = np.where(ok, cand, 0)
    d = np.where(ok, _sq(x, safe, x[nodes]), np.inf)
    order = np.argsort(d, axis=1, kind="stable")
    safe, d = np.take_along_axis(safe, order, 1), np.take_along_axis(d, order, 1)
    d[:, 1:][(safe[:, 1:] == safe[:, :-1]) & np.isfinite(d[:, 1:])] = np.inf  # the same candidate twice
    out = np.full((n, degree), -1, dtype=np.int64)
    rows = np.arange(n)
    for k in range(degree):
        best = d.argmin(axis=1)
        live = np.isfinite(d[rows, best])
        if not live.any():
            break
        pick = safe[rows, best]
        out[live, k] = pick[live]
        to_pick = _sq(x, safe, x[pick])
        d[live[:, None] & (alpha * alpha * to_pick <= d)] = np.inf
        d[rows, best] = np.inf
    return out


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, seed: int = SEED):
    """(graph, start): out-neighbours of every row (-1 none) and the entry nodes."""
    n = len(x)
    rng = np.random.default_rng(seed)
    centre = int(_sq(x, np.arange(n)[None, :], x.mean(axis=0)[None, :]).argmin())
    start = np.unique(np.concatenate([[centre], rng.choice(n, min(n, 8), replace=False)]))
    graph = np.full((n, degree), -1, dtype=np.int64)
    if n <= degree + 1:
        for i in range(n):
            graph[i, :n - 1] = np.delete(np.arange(n), i)
        return graph, start
    graph[:, :degree // 2] = rng.integers(0, n, (n, degree // 2))
    for alpha in (1.0, ALPHA):
        order = rng.permutation(n)
        for at in range(0, n, BUILD_BATCH):
            nodes = order[at:at + BUILD_BATCH]
            found, _ = beam_search(x, graph, start, x[nodes], beam)
            graph[nodes] = robust_prune(x, nodes, np.concatenate([found, graph[nodes]], axis=1), degree, alpha)
            _link_back(x, graph, nodes, alpha)
    return graph, start


def _link_back(x: np.ndarray, graph: np.ndarray, nodes: np.ndarray, alpha: float) -> None:
    """Add the reverse of new edges; lists that overflow are pruned."""
    degree = graph.shape[1]
    src = np.repeat(nodes, degree)
    dst = graph[nodes].ravel()
    src, dst = src[dst >= 0], dst[dst >= 0]
    order = np.argsort(dst, kind="stable")
    src, dst = src[order], dst[order]
    targets, first, counts = np.unique(dst, return_index=True, return_counts=True)
    width = int(counts.max()) if len(counts) else 0
    extra = np.full((len(targets), width), -1, dtype=np.int64)
    pos = np.arange(len(dst)) - np.repeat(first, counts)
    extra[np.repeat(np.arange(len(targets)), counts), pos] = src
    own = graph[targets]
    known = (extra[:, :, None] == own[:, None, :]).any(axis=2)
    extra[known] = -1
    free = (own < 0).sum(axis=1)
    need = (extra >= 0).sum(axis=1)
    small = np.nonzero((need > 0) & (need <= free))[0]
    for i in small:
        row = own[i]
        add = extra[i][extra[i] >= 0]
        row[np.nonzero(row < 0)[0][:len(add)]] = add
        graph[targets[i]] = row
    big = np.nonzero(need > free)[0]
    for at in range(0, len(big), BUILD_BATCH):
        b = big[at:at + BUILD_BATCH]
        graph[targets[b]] = robust_prune(x, targets[b], np.concatenate([own[b], extra[b]], axis=1), degree, alpha)


def lift(x: np.ndarray) -> np.ndarray:
    """Vectors with one more coordinate, all of the same length: nearest in distance
    to a lifted query (coordinate 0) is largest in inner product."""
    n2 = (x.astype(np.float64) ** 2).sum(axis=1)
    top = n2.max() if len(n2) else 0.0
    scale = 1.0 / np.sqrt(top) if top > 0 else 1.0
    extra = np.sqrt(np.maximum(top - n2, 0)) * scale
    return np.concatenate([x * scale, extra[:, None]], axis=1).astype(np.float32)


def lift_queries(q: np.ndarray) -> np.ndarray:
    n = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1, keepdims=True))
    return np.concatenate([q / np.maximum(n, 1e-300), np.zeros((len(q), 1))], axis=1).astype(np.float32)


def usable(df: DataFrame, vec: str = "embedding") -> DataFrame:
    """Rows with an id and a vector of finite components that are not all zero."""
    fine = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return df.filter(F.col("vec_id").isNotNull() & F.col(vec).isNotNull() & (F.size(vec) > 0)
                     & F.forall(vec, fine) & F.exists(vec, lambda v: v != 0))


def build_index(vectors: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per shard: node ids, vectors, graph and entry nodes as byte strings.

    ``vectors``: node long, embedding array; every row is indexed. Vectors of
    different lengths go to different shards. The rows are materialised in the
    shared folder, so that a lost executor costs one shard's work again.
    """
    ship_package(vectors.sparkSession)
    n = vectors.count()
    shards = max(1, -(-n // shard_rows))
    dealt = vectors.withColumn("_dim", F.size("embedding")).withColumn(
        "_shard", F.pmod(F.xxhash64("node", F.lit(SEED)), F.lit(shards)))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        x = np.array(pdf["embedding"].tolist(), dtype=np.float64)
        graph, start = build_graph(lift(x))
        return pd.DataFrame({"shard": [int(pdf["_shard"].iloc[0])], "dim": [x.shape[1]], "n": [len(x)],
                             "ids": [pdf["node"].to_numpy(np.int64).tobytes()], "vecs": [x.tobytes()],
                             "graph": [graph.astype(np.int32).tobytes()],
                             "start": [start.astype(np.int32).tobytes()]})

    return cut(dealt.groupBy("_dim", "_shard").applyInPandas(
        build, "shard long, dim int, n int, ids binary, vecs binary, graph binary, start binary"))


def search_index(index: DataFrame, queries: DataFrame, k: int, beam: int = SEARCH_BEAM) -> DataFrame:
    """query_id, node, score: the ``k`` best nodes of every shard for every query.

    ``queries``: query_id long, embedding array. Blocks of queries, packed as byte
    strings, meet each shard by a join on the shard; no query is broadcast.
    """
    ship_package(queries.sparkSession)

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("query_id")
        q = np.array(pdf["embedding"].tolist(), dtype=np.float64)
        return pd.DataFrame({"dim": [q.shape[1]], "qids": [pdf["query_id"].to_numpy(np.int64).tobytes()],
                             "qvecs": [q.tobytes()]})

    nq = queries.count()
    blocks = max(1, -(-nq // QUERY_BLOCK))
    packed = (queries.withColumn("_dim", F.size("embedding"))
              .withColumn("_b", F.pmod(F.xxhash64("query_id", F.lit(SEED)), F.lit(blocks)))
              .groupBy("_dim", "_b").applyInPandas(block, "dim int, qids binary, qvecs binary"))
    # every block is wanted by every shard of its dimension: a stated query set, in blocks
    top = index.agg(F.max("shard")).first()[0]
    if top is None:
        return queries.sparkSession.createDataFrame([], "query_id long, node long, score double")
    wanted = packed.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(top))))
    pairs = wanted.join(index, ["dim", "shard"]).repartition(
        F.xxhash64("dim", "shard", "qids"))

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                x = np.frombuffer(r.vecs, np.float64).reshape(r.n, r.dim)
                graph = np.frombuffer(r.graph, np.int32).reshape(r.n, -1).astype(np.int64)
                ids = np.frombuffer(r.ids, np.int64)
                start = np.frombuffer(r.start, np.int32).astype(np.int64)
                qids = np.frombuffer(r.qids, np.int64)
                q = np.frombuffer(r.qvecs, np.float64).reshape(len(qids), r.dim)
                lifted = lift(x)
                for at in range(0, len(qids), QUERY_BLOCK):
                    part = q[at:at + QUERY_BLOCK]
                    found, _ = beam_search(lifted, graph, start, lift_queries(part), max(beam, k))
                    qi, col = np.nonzero(found >= 0)
                    node = found[qi, col]
                    score = (x[node] * part[qi]).sum(axis=1)
                    by = np.lexsort((ids[node], -score, qi))
                    qi, node, score = qi[by], node[by], score[by]
                    first = np.searchsorted(qi, qi)
                    keep = np.arange(len(qi)) - first < k
                    yield pd.DataFrame({"query_id": qids[at:at + QUERY_BLOCK][qi[keep]],
                                        "node": ids[node[keep]], "score": score[keep]})

    return pairs.select("dim", "n", "ids", "vecs", "graph", "start", "qids", "qvecs").mapInPandas(
        run, "query_id long, node long, score double")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` nearest found by inner product.

    A query is never its own answer; ties go to the smaller vec_id. Null vectors,
    null ids, zero vectors and vectors with null or non-finite components take no
    part; vectors only meet others of their length. Of equal vectors one node is
    indexed and its members with the ``k + 1`` smallest ids stand for all: no other
    member can be among k answers. An empty table gives no rows.
    """
    base = usable(vectors.select("vec_id", "embedding"))
    # -0.0 and 0.0 are equal in the measure
    base = base.withColumn("embedding", F.transform("embedding", lambda v: F.when(v == 0, F.lit(0.0)).otherwise(v)
                                                    .cast("double")))
    keyed = base.withColumn("_key", F.struct(F.xxhash64("embedding"), F.xxhash64("embedding", F.lit(1))))
    w = Window.partitionBy("_key").orderBy("vec_id")
    members = cut(keyed.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k + 1)
                  .withColumn("node", F.when(F.col("_rn") == 1, F.col("vec_id")))
                  .withColumn("node", F.max("node").over(Window.partitionBy("_key"))))
    index = build_index(members.filter("_rn = 1").select("node", "embedding"), shard_rows)
    q = usable(queries.select("vec_id", "embedding")).select(
        F.col("vec_id").alias("query_id"), F.transform("embedding", lambda v: v.cast("double")).alias("embedding"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "node")
    # k + 1 nodes: one of them may be the query alone
    hits = (search_index(index, q, k + 1).withColumn("_r", F.row_number().over(best))
            .filter(F.col("_r") <= k + 1).drop("_r"))
    full = (hits.join(members.select("node", "vec_id"), "node").filter("vec_id != query_id"))
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (full.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def op4(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter("vec_id % 20 = 0"))
