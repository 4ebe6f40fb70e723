"""Predicates as data (F7), seeded draws of predicate values (F8), hit counts
(F11), hot / middle / cold KB selection (F9) and hit-rate targeting (F10)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filtra.config import PREDICATE_SEED, SCALAR_FIELDS
from filtra.functions.hashing import md5_uniform


def draw_document_ids(spark: SparkSession, sf_dir: str, n: int,
                      seed: int = PREDICATE_SEED) -> DataFrame:
    """n documentIds of the documents table in md5(seed:id) order (a seeded
    sample without replacement; n is capped at the number of documents)."""
    from filtra.sources.tables import read_table
    d = read_table(spark, sf_dir, "documents")
    ids = d.select(F.concat(F.lit("doc_"), F.lpad((F.col("doc_id") + 1).cast("string"), 8, "0"))
                   .alias("documentId"))
    return (ids.withColumn("_u", F.md5(F.concat(F.lit(f"{seed}:"), F.col("documentId"))))
            .orderBy("_u", "documentId").limit(int(n)).select("documentId"))


def draw_pool_predicates(spark: SparkSession, n: int, seed: int = PREDICATE_SEED,
                         pools=None, fields: Sequence[str] = SCALAR_FIELDS) -> DataFrame:
    """F8, as the workload draws them: every field value uniform over its pool,
    independently per predicate (qid = 1..n). Such predicates rarely match a
    stored row -- use :func:`draw_rows` when hits are needed."""
    from filtra.config import PoolSpec
    from filtra.sources.generator import pool_values
    pools = pools or PoolSpec()
    cards = pools.as_dict()
    base = spark.range(1, n + 1).withColumnRenamed("id", "qid")
    cols = []
    for f in fields:
        vals = pool_values(f, cards[f])
        u = md5_uniform(f"{seed}:{f}:", "qid")
        idx = F.least(F.floor(u * len(vals)).cast("int"), F.lit(len(vals) - 1))
        cols.append(F.element_at(F.array(*[F.lit(v) for v in vals]), idx + 1).alias(f))
    return base.select("qid", *cols)


def draw_rows(corpus: DataFrame, n: int, seed: int = PREDICATE_SEED,
              fields: Sequence[str] = SCALAR_FIELDS, key: str = "id") -> DataFrame:
    """F8: n stored rows in md5(seed:key) order, numbered qid = 1..n.

    Predicate values taken from stored rows always match at least that row
    (uniform independent draws of pool values nearly always match nothing).
    """
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    top = corpus.select(key, *fields).withColumn("_h", h).orderBy("_h", key).limit(int(n))
    w = Window.orderBy("_h", key)  # n rows after the limit
    return top.select(F.row_number().over(w).cast("long").alias("qid"),
                      F.col(key).alias("source_id"), *fields)


def batch_filter(corpus: DataFrame, preds: DataFrame,
                 fields: Sequence[str] = SCALAR_FIELDS, partition_key: str = "kbId",
                 id_col: str = "id") -> DataFrame:
    """(qid, id) for every corpus row matching each predicate row.

    Predicate rows hold (qid, fields...), null meaning "any value". The
    partition key is fixed in every predicate (as in every query of the
    workload), so the join is an equi-join on it with the remaining fields as
    null-or-equal conditions; the predicate table is broadcast when its row
    count is under the limit.
    """
    if preds.filter(F.col(partition_key).isNull()).limit(1).count():
        raise ValueError(f"every predicate must fix {partition_key}")
    n = preds.count()
    p = preds.select("qid", *[F.col(f).alias(f"_p_{f}") for f in fields])
    side = F.broadcast(p) if n <= 100_000 else p
    cond = F.col(partition_key) == F.col(f"_p_{partition_key}")
    for f in fields:
        if f != partition_key:
            cond = cond & (F.col(f"_p_{f}").isNull() | (F.col(f) == F.col(f"_p_{f}")))
    j = corpus.select(id_col, *fields).join(side, cond, "inner")
    return j.select("qid", F.col(id_col).alias("id"))


def in_list(corpus: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """F3 / F7 for lists of any length: the corpus rows whose ``key`` is among ``keys``.

    On a corpus bucketed by ``key`` only the list is shuffled (into the same buckets); its
    repetitions are dropped first. A null matches nothing.
    """
    listed = keys.select(key).filter(F.col(key).isNotNull()).distinct()
    return corpus.join(listed.hint("shuffle_hash"), key, "left_semi")


def hit_count(corpus: DataFrame, preds: DataFrame,
              fields: Sequence[str] = SCALAR_FIELDS) -> DataFrame:
    """hits and share per predicate; predicates with no hit report 0."""
    matches = batch_filter(corpus, preds, fields)
    counts = matches.groupBy("qid").agg(F.count(F.lit(1)).alias("hits"))
    total = corpus.count()
    res = preds.select("qid").join(counts, "qid", "left")
    return res.select("qid", F.coalesce("hits", F.lit(0)).cast("long").alias("hits"),
                      F.round(F.coalesce("hits", F.lit(0)) / F.lit(float(max(total, 1))), 6)
                      .alias("share"))


def kb_tiers(corpus: DataFrame, key: str = "kbId") -> DataFrame:
    """F9 variant: KBs ranked by measured row count; hot = rank 1, middle =
    rank n div 2 + 1, cold = rank n. Works on the per-KB count table only."""
    counts = corpus.groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
    w = Window.orderBy(F.col("rows").desc(), F.col(key).asc())  # one row per KB
    ranked = counts.withColumn("pos", F.row_number().over(w) - 1) \
        .withColumn("n", F.count(F.lit(1)).over(Window.partitionBy()))
    tier = (F.when(F.col("pos") == 0, "hot")
            .when(F.col("pos") == F.floor(F.col("n") / 2), "middle")
            .when(F.col("pos") == F.col("n") - 1, "cold"))
    return ranked.withColumn("tier", tier).filter(F.col("tier").isNotNull()) \
        .select("tier", key, "rows", "pos")


def kb_pool_tiers(pool: Sequence[str], key: str = "kbId"):
    """F9 as coded in the workload: hot / middle / cold = pool positions
    0, n div 2 and n - 1 (whatever their measured sizes)."""
    n = len(pool)
    return [("hot", 0, pool[0]), ("middle", n // 2, pool[n // 2]), ("cold", n - 1, pool[n - 1])]


def hit_rate_candidates(corpus: DataFrame, partition_key: str = "kbId",
                        fields: Sequence[str] = ("study", "site", "patient", "visit")) -> DataFrame:
    """hit rate of every predicate over GROUPING SETS that all contain the
    partition key: (kb), (kb, f) for each field, (kb, all fields).

    One scan and one aggregate (Expand + partial aggregation); the only
    driver value is the corpus row count. An equality with a null value matches
    nothing, so a group of null values is no predicate (null means left out).
    """
    total = corpus.count()
    fields = list(fields)
    sets = [[partition_key]] + [[partition_key, f] for f in fields] + [[partition_key, *fields]]
    g = corpus.groupingSets([[F.col(c) for c in s] for s in sets], partition_key, *fields).agg(
        F.count(F.lit(1)).alias("hits"),
        F.grouping_id().alias("_gid"),
        *[F.grouping(c).alias(f"_out_{c}") for c in [partition_key, *fields]])
    for c in [partition_key, *fields]:
        g = g.filter((F.col(f"_out_{c}") == 1) | F.col(c).isNotNull())
    # grouping_id has one bit per column left out of the set
    n_fields = F.lit(len(fields) + 1) - F.bit_count("_gid")
    return g.select(partition_key, *fields, "hits", n_fields.cast("int").alias("n_fields"),
                    (F.col("hits") * F.lit(100.0) / F.lit(float(max(total, 1)))).alias("rate_pct"))


def nearest_to_targets(cands: DataFrame, targets: Sequence[float],
                       partition_key: str = "kbId",
                       fields: Sequence[str] = ("study", "site", "patient", "visit")) -> DataFrame:
    """For each target rate (%), the candidate predicate with the nearest rate;
    ties by fewer fields, then field values (nulls first).

    ``min(struct(distance, ...))`` per target is an ordinary aggregate, so it
    is combined map-side: no task ever holds all candidates of a target.
    """
    parts = [cands.withColumn("target_pct", F.lit(float(t))) for t in targets]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    best = F.min(F.struct(
        F.abs(F.col("rate_pct") - F.col("target_pct")).alias("dist"), "n_fields",
        partition_key, *fields, "hits", "rate_pct")).alias("b")
    return u.groupBy("target_pct").agg(best).select(
        "target_pct", *[F.col(f"b.{c}").alias(c) for c in
                        (partition_key, *fields, "hits", "rate_pct", "n_fields")])
