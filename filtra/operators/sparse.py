"""Sparse retrieval: BM25 posting table (R6) and posting-list search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filtra.config import BM25_B, BM25_K1
from filtra.functions.vectors import SCORE_SCALE
from filtra.operators.topk import topk

# Fixed value: token pattern -- lower-cased text split on runs of anything
# that is not an ASCII letter or digit; empty pieces are dropped.
TOKEN_SPLIT = "[^a-z0-9]+"

# Query-term tables up to this many rows are broadcast to the posting scan.
MAX_BROADCAST_TERMS = 2_000_000


def tokens_expr(text_col: str = "content"):  # noqa: D401
    """array<string> of the non-empty tokens of a text column."""
    return F.filter(F.split(F.lower(F.col(text_col)), TOKEN_SPLIT), lambda t: t != "")


# A token is "hot" when its document frequency exceeds total_postings /
# MAX_HOT_TOKENS; since the frequencies sum to total_postings there are at most
# MAX_HOT_TOKENS hot tokens, which bounds the broadcast below.
MAX_HOT_TOKENS = 20_000


def term_frequencies(docs: DataFrame, id_col: str = "id",
                     text_col: str = "content") -> DataFrame:
    """(id, token, tf, dl): one row per distinct token of each document."""
    toks = docs.select(F.col(id_col).alias("id"), tokens_expr(text_col).alias("_toks"))
    # explode_outer: a plain explode makes Catalyst infer size(tokens) > 0 and
    # push it below joins, which would tokenise every text twice (and texts
    # the join drops). Documents without tokens give one null row, dropped.
    exploded = toks.select("id", F.size("_toks").alias("_dl"),
                           F.explode_outer("_toks").alias("token")).filter(F.col("token").isNotNull())
    return exploded.groupBy("id", "token").agg(F.count(F.lit(1)).alias("tf"),
                                              F.max("_dl").alias("dl"))


def bm25_postings(docs: DataFrame, id_col: str = "id", text_col: str = "content",
                  k1: float = BM25_K1, b: float = BM25_B,
                  max_hot: int = MAX_HOT_TOKENS, persist_tf: bool = True) -> DataFrame:
    """(id, token, tf, weight) with Okapi BM25 term weights.

    weight = idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl)),
    idf = ln(1 + (N - df + 0.5) / (df + 0.5)).

    Text is tokenised once: the (id, token, tf, dl) table is checkpointed and
    N, avgdl and the posting count are read from it and from the id column.
    Attaching df is a join on token, whose frequent tokens are skewed keys;
    they are split off: hot tokens (provably at most ``max_hot``) are
    broadcast, the remaining rows are shuffled by token with no key above the
    hot threshold.
    """
    tf = term_frequencies(docs, id_col, text_col)
    if persist_tf:
        tf = persist_index(tf)
    n_docs = docs.select(id_col).count()
    st = tf.agg(F.count(F.lit(1)).alias("p"), F.sum("tf").alias("t")).first()
    avgdl = (float(st["t"] or 0) / n_docs) if n_docs else 0.0
    hot_df = max(1, -(-int(st["p"] or 0) // max_hot))
    df = tf.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    hot = df.filter(F.col("df") > hot_df)
    cold = df.filter(F.col("df") <= hot_df)
    j_hot = tf.join(F.broadcast(hot), "token")
    j_cold = tf.join(F.broadcast(hot.select("token")), "token", "left_anti").join(cold, "token")
    j = j_hot.unionByName(j_cold)
    idf = F.log(F.lit(1.0) + (F.lit(float(n_docs)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * F.col("dl") / F.lit(avgdl if avgdl else 1.0))
    weight = idf * F.col("tf") * F.lit(k1 + 1.0) / (F.col("tf") + norm)
    return j.select("id", "token", F.col("tf").cast("long").alias("tf"), weight.alias("weight"))


def term_stats(docs: DataFrame, id_col: str = "id", text_col: str = "content"):
    """Tokenise once: (tf table checkpointed, N, avgdl) for BM25 weighting."""
    tf = persist_index(term_frequencies(docs, id_col, text_col))
    n_docs = docs.select(id_col).count()
    st = tf.agg(F.sum("tf").alias("t")).first()
    avgdl = (float(st["t"] or 0) / n_docs) if n_docs else 0.0
    return tf, n_docs, avgdl


def bm25_for_tokens(tf: DataFrame, n_docs: int, avgdl: float, tokens: DataFrame,
                    k1: float = BM25_K1, b: float = BM25_B) -> DataFrame:
    """BM25 postings (id, token, tf, weight) of the given tokens only.

    What a query needs: its tokens' posting rows (broadcast semi-join, no
    shuffle of the tf table) and their document frequencies -- a table with
    one row per query token, so its broadcast is bounded by the query.
    Weights equal those of :func:`bm25_postings` for the same tokens.
    """
    tk = tokens.select("token").distinct()
    n = tk.count()
    if n > MAX_BROADCAST_TERMS:
        raise ValueError(f"{n} query tokens: build the full posting index instead")
    rows = tf.join(F.broadcast(tk), "token")
    df = rows.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    j = rows.join(F.broadcast(df), "token")
    idf = F.log(F.lit(1.0) + (F.lit(float(n_docs)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * F.col("dl") / F.lit(avgdl if avgdl else 1.0))
    weight = idf * F.col("tf") * F.lit(k1 + 1.0) / (F.col("tf") + norm)
    return j.select("id", "token", F.col("tf").cast("long").alias("tf"), weight.alias("weight"))


def persist_index(df: DataFrame) -> DataFrame:
    """Materialise an index table once (reliable checkpoint in the shared
    folder): later searches read it instead of re-deriving it, and its lineage
    no longer reaches back to the raw text."""
    from pyspark import StorageLevel
    from filtra.session import shared_dir
    shared_dir(df.sparkSession)
    # persist first: the eager checkpoint runs one job to materialise and
    # another to write; without it the table would be computed twice
    tmp = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return tmp.checkpoint(eager=True)
    finally:
        tmp.unpersist()


def query_terms(postings: DataFrame, id_value: int, qid=None) -> DataFrame:
    """The posting row of one stored document as a query (token, qweight)."""
    q = postings.filter(F.col("id") == id_value).select("token", F.col("weight").alias("qweight"))
    if qid is not None:
        q = q.withColumn("qid", F.lit(qid).cast("long"))
    return q


def _join_terms(postings: DataFrame, terms: DataFrame, on=None) -> DataFrame:
    n = terms.count()
    side = F.broadcast(terms) if n <= MAX_BROADCAST_TERMS else terms
    if on is None:
        on = ["token"]
    if "tb" in postings.columns and "tb" in terms.columns:
        on = ["tb", *on]
    return postings.join(side, list(on))


# Token buckets of a stored posting index (see write_postings).
POSTING_BUCKETS = 64
MAX_RECORDS_PER_FILE = 5_000_000


def token_bucket(col="token", buckets: int = POSTING_BUCKETS):
    c = F.col(col) if isinstance(col, str) else col
    return F.pmod(F.xxhash64(c), F.lit(buckets)).cast("int")


def write_postings(postings: DataFrame, path: str, buckets: int = POSTING_BUCKETS,
                   mode: str = "errorifexists") -> None:
    """Store a posting index partitioned by token bucket ``tb``. Searches add
    ``tb IN (query buckets)`` and join on (tb, token), so only the buckets of
    the query's terms are read. Rows are spread over (bucket, id-hash) writers, so a bucket
    holding a frequent token is not one task."""
    out = postings.withColumn("tb", token_bucket("token", buckets))
    out = out.repartition(F.col("tb"), F.pmod(F.xxhash64("id"), F.lit(16)))
    # sorted by token, row groups of other tokens are skipped; the bucket count travels
    # with the rows (one dictionary entry per file)
    (out.withColumn("n_tb", F.lit(int(buckets))).sortWithinPartitions("tb", "token").write.mode(mode)
     .option("maxRecordsPerFile", MAX_RECORDS_PER_FILE).partitionBy("tb").parquet(path))


def sparse_scores(postings: DataFrame, terms: DataFrame, keys: Sequence[str] = (),
                  buckets: int = POSTING_BUCKETS, on: Sequence[str] | None = None) -> DataFrame:
    """(keys..., id, score): sum over shared tokens of weight * qweight.

    ``on`` (default: token) may add attribute columns present on both sides,
    so per-query filters are applied inside the join.
    """
    if "tb" in postings.columns:
        if "n_tb" in postings.columns:  # the stored index knows its bucket count
            row = postings.select("n_tb").first()
            buckets = row["n_tb"] if row else buckets
            postings, terms = postings.drop("n_tb"), terms.drop("tb")
        if "tb" not in terms.columns:
            terms = terms.withColumn("tb", token_bucket("token", buckets))
        # static pruning: the query's buckets (at most ``buckets`` values)
        # become an IN filter on the partition column
        tbs = sorted(r["tb"] for r in terms.select("tb").distinct().collect())
        postings = postings.filter(F.col("tb").isin(tbs))
    hits = _join_terms(postings, terms, on)
    return hits.groupBy(*keys, "id").agg(
        F.round(F.sum(F.col("weight") * F.col("qweight")), SCORE_SCALE).alias("score"))


def sparse_search(postings: DataFrame, terms: DataFrame, k: int = 10,
                  allowed_ids: DataFrame | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Filtered top-k by sparse inner product; (keys..., rank, id, score).

    ``allowed_ids`` (a DataFrame with ``id``) is the filtered corpus: rows
    outside it are removed before ranking.
    """
    scores = sparse_scores(postings, terms, keys)
    if allowed_ids is not None:
        scores = scores.join(allowed_ids.select("id"), "id", "left_semi")
    return topk(scores, k, keys=list(keys)).select(*keys, "rank", "id", "score")


def sparse_rows(postings: DataFrame) -> DataFrame:
    """Row form (id, vec map<token, weight>) of a posting table.

    One map per document, bounded by that document's distinct tokens.
    """
    return postings.groupBy("id").agg(
        F.map_from_entries(F.collect_list(F.struct("token", "weight"))).alias("vec"))


def terms_literal(terms: DataFrame):
    """Bind one query's (token, qweight) rows as one foldable map literal (a query vector is a parameter)."""
    import json
    d = {r["token"]: float(r["qweight"]) for r in terms.collect()}
    return F.from_json(F.lit(json.dumps(d)), "map<string,double>")
