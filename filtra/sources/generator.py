"""Synthetic chunk corpora derived from stored documents.

Every random quantity is a hash of a key, so results do not depend on
partitioning, task retries or the number of executors:

* attributes, chunk counts and sparse vectors: md5-based uniforms (reproducible in SQL);
* dense vectors: xxhash64-based uniforms (Spark only, faster).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filtra.config import (CHUNKS_PER_DOC_MAX, CHUNKS_PER_DOC_MIN, CONTENT_LENGTH, PoolSpec,
                           QUERY_SEED, SEED, SPARSE_NNZ_QUERY, SPARSE_NNZ_ROW, SPARSE_VOCAB,
                           ZIPF_ALPHA)
from filtra.functions.hashing import md5_uint32, md5_uniform
from filtra.functions.vectors import normalize
from filtra.operators.ordering import running_sum

# Pool value formats (prefix, digits) per field.
POOL_FORMATS = {
    "kbId": ("kb_", 2),
    "study": ("S", 3),
    "site": ("SITE_", 3),
    "patient": ("P", 5),
    "visit": ("V", 2),
}
# md5 salt per drawn field.
FIELD_SALTS = {"kbId": "kb:", "study": "study:", "site": "site:", "patient": "patient:",
               "visit": "visit:"}
# Filler of the content template, repeated to the wanted length.
CONTENT_FILLER = "a placeholder passage of a document chunk; "


def pool_values(field: str, card: int) -> list[str]:
    prefix, digits = POOL_FORMATS[field]
    return [f"{prefix}{i:0{digits}d}" for i in range(card)]


def value_pools(spark: SparkSession, pools: PoolSpec = PoolSpec()) -> DataFrame:
    """(field, pos, value) for the five pools, built with Spark expressions."""
    parts = []
    for field, card in pools.as_dict().items():
        prefix, digits = POOL_FORMATS[field]
        parts.append(spark.range(card).select(
            F.lit(field).alias("field"), F.col("id").cast("int").alias("pos"),
            F.concat(F.lit(prefix), F.lpad(F.col("id").cast("string"), digits, "0")).alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def zipf_cumulative(card: int, alpha: float) -> list[float]:
    """Upper cumulative probabilities of ranks 1..card under p ~ 1 / rank^alpha."""
    w = [1.0 / math.pow(r, alpha) for r in range(1, card + 1)]
    s = sum(w)
    acc, out = 0.0, []
    for x in w:
        acc += x / s
        out.append(acc)
    return out


def _sql_str(v: str) -> str:
    return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _md5_uniform_sql(salt: str, key: str) -> str:
    return (f"(cast(conv(substring(md5(concat({_sql_str(salt)}, cast({key} AS STRING))), 1, 8), "
            f"16, 10) AS BIGINT) / 4294967296.0D)")


def zipf_assign(key, field: str, card: int, alpha: float = ZIPF_ALPHA,
                salt: str | None = None) -> Column:
    """D3: a pool value drawn with probability (1 / rank^alpha) / sum.

    u = md5 uniform of (salt, key); the value is the first rank whose
    cumulative probability exceeds u. alpha = 0 is uniform (floor(u * card)).
    The pool and its cumulative bounds are literals of one expression: no
    join, no broadcast.
    """
    if card < 1:
        raise ValueError("pool must not be empty")
    if not isinstance(key, str):
        raise TypeError("key must be a column name")
    u = _md5_uniform_sql(salt if salt is not None else FIELD_SALTS[field], f"`{key}`")
    values = ", ".join(_sql_str(v) for v in pool_values(field, card))
    if alpha == 0:
        idx = f"least(cast(floor({u} * {card}) AS INT), {card - 1})"
    else:
        cum = zipf_cumulative(card, alpha)[:-1]
        idx = " + ".join(f"(CASE WHEN {u} >= {c!r}D THEN 1 ELSE 0 END)" for c in cum) or "0"
    return F.expr(f"element_at(array({values}), ({idx}) + 1)")


def _check_span(lo: int, hi: int) -> None:
    if not 1 <= lo <= hi:
        raise ValueError(f"a document needs between 1 and {hi} chunks at least: got {lo}..{hi}")


def chunk_counts(key, lo: int = CHUNKS_PER_DOC_MIN, hi: int = CHUNKS_PER_DOC_MAX) -> Column:
    """n ~ U{lo..hi} inclusive from md5('n:' || key)."""
    _check_span(lo, hi)
    return (F.lit(lo) + F.pmod(md5_uint32("n:", key), F.lit(hi - lo + 1))).cast("int")


def chunk_expand(docs: DataFrame, lo: int = CHUNKS_PER_DOC_MIN, hi: int = CHUNKS_PER_DOC_MAX,
                 total_rows: int | None = None, start_id: int = 0,
                 alpha: float = ZIPF_ALPHA, pools: PoolSpec = PoolSpec(),
                 doc_col: str = "doc_id", rows_per_task: int = 250_000) -> DataFrame:
    """Documents -> chunks.

    Each document gets n chunks sharing its attributes; ids are contiguous
    from ``start_id`` in document order; with ``total_rows`` the output stops
    there (the last document may be cut). The document offset is an exclusive
    running sum of n computed blockwise, so no task sees all documents.
    Result: id, documentId, n, chunk_no, kbId, study, site, patient, visit.
    """
    d = docs.select(F.col(doc_col).alias("doc_id"))
    d = d.withColumn("n", chunk_counts("doc_id", lo, hi))
    st = d.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("rows")).first()
    d = running_sum(d, [], ["doc_id"], "n", "offset", exclusive=True)
    if total_rows is not None:
        # documents that start at or after the cut produce nothing
        d = d.filter(F.col("offset") < F.lit(int(total_rows)))
    # Each document becomes 20-500 rows: spread the documents (small) over
    # enough tasks for the rows they will produce before exploding, instead of
    # expanding inside however few tasks read the documents.
    n_rows = int(st["rows"] or 0)
    if total_rows is not None:
        n_rows = min(n_rows, int(total_rows))
    parts = max(1, min(-(-int(n_rows) // rows_per_task), 1 << 16))
    d = d.repartition(parts, "doc_id")
    d = d.select("*", *[zipf_assign("doc_id", field, card, alpha).alias(field)
                        for field, card in pools.as_dict().items()],
                 F.concat(F.lit("doc_"), F.lpad((F.col("doc_id") + 1).cast("string"), 8, "0"))
                 .alias("documentId"))
    ch = d.withColumn("chunk_no", F.explode(F.sequence(F.lit(1), F.col("n"))))
    ch = ch.withColumn("id", (F.lit(int(start_id)) + F.col("offset") + F.col("chunk_no") - 1)
                       .cast("long"))
    if total_rows is not None:
        ch = ch.filter(F.col("id") < F.lit(int(start_id) + int(total_rows)))
    return ch.select("id", "documentId", "n", "chunk_no", "kbId", "study", "site", "patient",
                     "visit")


# Up to this dimension a vector is one codegen'd SQL expression (its size grows with
# dim^2 before subexpression elimination); above it the same draws come from a
# higher-order function. Both give the same vectors.
EXPR_MAX_DIM = 16


def _xx_uniform_sql(seed: int, key: str, j: int, stream: int) -> str:
    h = f"xxhash64({seed}, {key}, {j}L, {stream})"
    return f"((cast(shiftrightunsigned({h}, 11) AS DOUBLE) + 0.5D) / 9007199254740992.0D)"


def dense_vectors(key, dim: int, seed: int = SEED) -> Column:
    """Dim gaussian components (Box-Muller of hashed uniforms), float32,
    L2-normalised (zero norm counts as 1). ``key`` is a column or its name."""
    if dim > EXPR_MAX_DIM or not isinstance(key, str):
        return normalize(_raw_components(key, dim, seed))
    k = f"`{key}`"
    comps = [f"cast(cast(sqrt(-2.0D * ln({_xx_uniform_sql(seed, k, j, 0)})) * "
             f"cos({2.0 * math.pi!r}D * {_xx_uniform_sql(seed, k, j, 1)}) AS FLOAT) AS DOUBLE)"
             for j in range(dim)]
    norm = "sqrt(" + " + ".join(f"{c} * {c}" for c in comps) + ")"
    safe = f"(CASE WHEN {norm} = 0 THEN 1.0D ELSE {norm} END)"
    return F.expr("array(" + ", ".join(f"cast({c} / {safe} AS FLOAT)" for c in comps) + ")")


def _raw_components(key, dim: int, seed: int) -> Column:
    """The draws of :func:`dense_vectors` for any dimension, before normalising."""
    k = F.col(key) if isinstance(key, str) else key

    def uniform(j, stream: int) -> Column:
        h = F.xxhash64(F.lit(seed), k, j, F.lit(stream))
        return (F.shiftrightunsigned(h, 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))

    return F.transform(F.sequence(F.lit(0).cast("long"), F.lit(dim - 1).cast("long")), lambda j: (
        F.sqrt(F.lit(-2.0) * F.log(uniform(j, 0))) * F.cos(F.lit(2.0 * math.pi) * uniform(j, 1))).cast("float"))


def _coprime_steps(vocab: int, count: int = 16) -> list[int]:
    """The first ``count`` primes above ``vocab``: each is coprime with it."""
    out, c = [], vocab + 1
    while len(out) < count:
        if c > 1 and all(c % p for p in range(2, int(math.isqrt(c)) + 1)):
            out.append(c)
        c += 1
    return out


def sparse_vectors(key, vocab: int = SPARSE_VOCAB, nnz: int = SPARSE_NNZ_ROW,
                   seed: int = SEED) -> Column:
    """min(nnz, vocab) distinct token ids in [0, vocab) with U(0,1) weights.

    token_j = (a + j * b) mod vocab with b coprime to vocab, so j -> token is
    injective for j < vocab: distinct ids without rejection sampling. All draws are
    digits of md5 digests (four draws a digest), so any engine with md5 can restate
    a row.
    """
    if not isinstance(key, str):
        raise TypeError("key must be a column name")
    m = min(int(nnz), int(vocab))
    steps = _coprime_steps(vocab)

    def digest(text: str) -> str:
        return f"md5(concat({_sql_str(text)}, cast(`{key}` AS STRING)))"

    def word(d: str, i: str) -> str:
        return f"cast(conv(substring({d}, 1 + 8 * {i}, 8), 16, 10) AS BIGINT)"

    numbers = f"sequence(0, {m - 1})"
    steps_sql = ", ".join(f"{x}L" for x in steps)
    # one-element arrays bind a value, so that it is computed once a row
    ab = (f"transform(array({digest(f'sa:{seed}:')}), d -> named_struct('a', {word('d', '0')} % {vocab}L, "
          f"'b', element_at(array({steps_sql}), cast({word('d', '1')} % {len(steps)}L + 1 AS INT))))")
    toks = f"transform({ab}, s -> transform({numbers}, j -> cast((s.a + j * s.b) % {vocab}L AS INT)))[0]"
    digits = ", ".join(digest(f"sw{q}:{seed}:") for q in range(-(-m // 4)))
    wts = (f"transform(array(concat({digits})), h -> transform({numbers}, j -> "
           f"cast(({word('h', 'j')} + 0.5D) / 4294967296.0D AS FLOAT)))[0]")
    return F.expr(f"map_from_arrays({toks}, {wts})")


def with_content(df: DataFrame, length: int = CONTENT_LENGTH, col: str = "content") -> DataFrame:
    """The same placeholder text of ``length`` characters on every row."""
    return df.withColumn(col, F.rpad(F.lit(""), int(length), CONTENT_FILLER))


def query_set(keys: DataFrame, key: str, dim: int, seed: int = QUERY_SEED,
              vocab: int = SPARSE_VOCAB, nnz: int = SPARSE_NNZ_QUERY) -> DataFrame:
    """Independent dense and sparse query vectors from a second seed,
    one per key row (qid = key)."""
    return keys.select(F.col(key).cast("long").alias("qid"),
                       dense_vectors(key, dim, seed).alias("q_dense"),
                       sparse_vectors(key, vocab, nnz, seed).alias("q_sparse"))


def generated_chunks(spark: SparkSession, sf_dir: str, dim: int = 8,
                     with_vectors: bool = True, **kw) -> DataFrame:
    """Fixture 4: the documents table expanded 1:N into a skewed chunk corpus."""
    from filtra.sources.tables import read_table
    ch = chunk_expand(read_table(spark, sf_dir, "documents"), **kw)
    if with_vectors:
        ch = ch.withColumn("embedding", dense_vectors("id", dim)) \
            .withColumn("sparse_embedding", sparse_vectors("id"))
    return ch


__all__: Sequence[str] = (
    "value_pools", "zipf_assign", "chunk_expand", "dense_vectors", "sparse_vectors",
    "with_content", "query_set", "generated_chunks", "pool_values", "zipf_cumulative",
)
