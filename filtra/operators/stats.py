"""Latency, throughput and creation-log analytics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filtra.config import COLLECTION_LIMIT, SAMPLE_EVERY
from filtra.operators.ordering import join_on, row_index, running_sum, running_sum_by_index


# ----------------------------------------------------------- percentiles

def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str,
                      probs: Sequence[float], names: Sequence[str]) -> DataFrame:
    """Exact interpolated percentiles per key (same definition as numpy's
    default and SQL ``quantile_cont``): h = (n - 1) p, v[floor h] +
    (h - floor h) (v[ceil h] - v[floor h]).

    Values are numbered per key with the range-partitioned ``row_index``, and
    only the two rows around each h are joined back, so no task ever holds a
    whole group, and null keys are a group -- unlike a percentile aggregate, whose buffer grows with the
    distinct values of the group.
    """
    keys = list(keys)
    base = df.select(*keys, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    idx = row_index(base, keys, ["_v"], "_pos_idx")
    cnt = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    need = []
    for i, p in enumerate(probs):
        h = (F.col("_n") - 1) * F.lit(float(p))
        for role, pos in (("lo", F.floor(h)), ("hi", F.ceil(h))):
            need.append(F.struct(F.lit(i).alias("_i"), F.lit(role).alias("_role"),
                                 (pos + 1).cast("long").alias("_pos"), h.alias("_h")))
    wanted = cnt.select(*keys, F.explode(F.array(*need)).alias("_w")).select(*keys, "_w.*")
    got = idx.withColumnRenamed("_pos_idx", "_pos").transform(join_on, wanted, [*keys, "_pos"])
    per = got.groupBy(*keys, "_i").agg(
        F.max(F.when(F.col("_role") == "lo", F.col("_v"))).alias("_lo"),
        F.max(F.when(F.col("_role") == "hi", F.col("_v"))).alias("_hi"),
        F.max("_h").alias("_h"))
    res = per.withColumn("_r", F.col("_lo") + (F.col("_h") - F.floor("_h"))
                         * (F.col("_hi") - F.col("_lo")))
    return res.groupBy(*keys).agg(*[F.max(F.when(F.col("_i") == i, F.col("_r"))).alias(n)
                                    for i, n in enumerate(names)])


def weighted_percentiles(df: DataFrame, keys: Sequence[str], value: str, count: str,
                         probs: Sequence[float], names: Sequence[str]) -> DataFrame:
    """The percentiles of :func:`exact_percentiles` from (value, count) rows.

    Each value's rows span positions of a running count per key, computed blockwise; a
    percentile's two positions are looked up in those spans. Null values do not count.
    """
    keys = list(keys)
    base = (df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v"))
            .agg(F.sum(count).alias("_c")))
    spans = running_sum(base, keys, ["_v"], "_c", "_to")
    total = base.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    need = []
    for i, p in enumerate(probs):
        h = (F.col("_n") - 1) * F.lit(float(p))
        for role, pos in (("lo", F.floor(h)), ("hi", F.ceil(h))):
            need.append(F.struct(F.lit(i).alias("_i"), F.lit(role).alias("_role"),
                                 (pos + 1).cast("long").alias("_pos"), h.alias("_h")))
    # a few positions a key
    wanted = total.select(*keys, F.array(*need).alias("_need"))
    got = (join_on(spans, wanted, keys)
           .withColumn("_w", F.explode(F.filter("_need", lambda w: (w["_pos"] <= F.col("_to"))
                                                & (w["_pos"] > F.col("_to") - F.col("_c")))))
           .select(*keys, "_v", "_w.*"))
    per = got.groupBy(*keys, "_i").agg(
        F.max(F.when(F.col("_role") == "lo", F.col("_v"))).alias("_lo"),
        F.max(F.when(F.col("_role") == "hi", F.col("_v"))).alias("_hi"), F.max("_h").alias("_h"))
    r = F.col("_lo") + (F.col("_h") - F.floor("_h")) * (F.col("_hi") - F.col("_lo"))
    return per.withColumn("_r", r).groupBy(*keys).agg(
        *[F.max(F.when(F.col("_i") == i, F.col("_r"))).alias(n) for i, n in enumerate(names)])


# ------------------------------------------------------------------- G1, G2

def latency_summary(samples: DataFrame, keys: Sequence[str], value: str = "latency_ms",
                    labels: DataFrame | None = None) -> DataFrame:
    """G1: n, p50/p95/p99, mean, min, max per label; labels without samples
    (present in ``labels`` only) report zeros."""
    keys = list(keys)
    basic = samples.groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean_ms"),
        F.min(value).alias("min_ms"), F.max(value).alias("max_ms"))
    pct = exact_percentiles(samples, keys, value, (0.5, 0.95, 0.99),
                            ("p50_ms", "p95_ms", "p99_ms"))
    stats = join_on(basic, pct, keys, "left")
    if labels is not None:
        stats = join_on(labels.select(*keys).distinct(), stats, keys, "left")
    cols = ["p50_ms", "p95_ms", "p99_ms", "mean_ms", "min_ms", "max_ms"]
    return stats.select(*keys, F.coalesce("n", F.lit(0)).cast("long").alias("n"),
                        *[F.round(F.coalesce(c, F.lit(0.0)), 6).alias(c) for c in cols])


def throughput(log: DataFrame, keys: Sequence[str] = ("concurrency",),
               window_s: float | None = None) -> DataFrame:
    """Requests and QPS per key. The divisor is the configured window when
    given, else the observed span of the key's requests; floor 1 s."""
    span = (F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / F.lit(1e6)
    agg = log.groupBy(*keys).agg(F.count(F.lit(1)).alias("requests"), span.alias("_span"))
    win = F.lit(float(window_s)) if window_s is not None else F.col("_span")
    return agg.select(*keys, "requests",
                      F.round(F.greatest(win, F.lit(1.0)), 6).alias("window_s"),
                      F.round(F.col("requests") / F.greatest(win, F.lit(1.0)), 2).alias("qps"))


# --------------------------------------------------------- creation log

def until_failure(event_log: DataFrame) -> DataFrame:
    """Each phase's events up to and with its first failure; what comes later does not count.

    A phase stops at its first failing event, so the log of a study that stops there feeds G3,
    G4, G5, G10 and G11 through this. Phases without a failure stay whole.
    """
    stop = (event_log.filter(F.col("event") == "create_failed").groupBy("phase")
            .agg(F.min("iteration").alias("_stop")))
    # one row per phase
    return (event_log.join(F.broadcast(stop), "phase", "left")
            .filter(F.col("_stop").isNull() | (F.col("iteration") <= F.col("_stop"))).drop("_stop"))


def phase_totals(event_log: DataFrame) -> DataFrame:
    """(phase, n, wall_s): successful creations and wall time per phase."""
    return event_log.groupBy("phase").agg(
        F.count(F.when(F.col("event") != "create_failed", 1)).alias("n"),
        F.max("elapsed_s").alias("wall_s"))


def phase_summary(totals: DataFrame) -> DataFrame:
    """Per phase start, n, wall seconds, rate; plus a total row (phase null).

    ``totals`` has one row per phase, so the frames below run over a table as
    small as the number of phases.
    """
    before = Window.orderBy("phase").rowsBetween(Window.unboundedPreceding, -1)
    per = totals.select("phase", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"),
                        "n", "wall_s")
    rolled = per.rollup("phase").agg(F.min("start").alias("start"), F.sum("n").alias("n"),
                                     F.sum("wall_s").alias("wall_s"))
    return rolled.select(
        "phase", F.col("start").cast("long").alias("start"), F.col("n").cast("long").alias("n"),
        F.round("wall_s", 1).alias("wall_s"),
        F.round(F.when(F.col("wall_s") > 0, F.col("n") / F.col("wall_s")), 1).alias("rate"))


def running_created(event_log: DataFrame) -> DataFrame:
    """created_so_far at every event: creations in earlier phases plus
    successes so far in this phase (running sum by iteration, blockwise)."""
    ok = event_log.withColumn("_ok", F.when(F.col("event") != "create_failed", 1).otherwise(0))
    run = running_sum_by_index(ok, ["phase"], "iteration", "_ok", "_run")
    totals = phase_totals(event_log)
    before = Window.orderBy("phase").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("phase", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    # one row per phase
    out = run.join(F.broadcast(starts), "phase")
    return out.withColumn("created_so_far", (F.col("_start") + F.col("_run")).cast("long")) \
        .drop("_ok", "_run", "_start")


def growth_rate(created: DataFrame, limit: int = COLLECTION_LIMIT) -> DataFrame:
    """Marginal cost per created item (slope of create/list time on the
    created count) and the share of the limit reached, per phase."""
    ok = created.filter(F.col("event") != "create_failed")
    return ok.groupBy("phase").agg(
        F.round(F.regr_slope("create_ms", "created_so_far"), 6).alias("create_ms_per_item"),
        F.round(F.regr_slope("list_ms", "created_so_far"), 6).alias("list_ms_per_item"),
        F.max("created_so_far").alias("created"),
        F.round(F.max("created_so_far") / F.lit(float(limit)), 6).alias("share_of_limit"))


def latency_trend(created: DataFrame, step: int = 1000) -> DataFrame:
    """p50 / p99 of create and list time per size bucket of created_so_far,
    and the p50 ratios to the first bucket."""
    ok = created.filter(F.col("event") != "create_failed") \
        .withColumn("bucket", (F.floor(F.col("created_so_far") / step) * step).cast("long"))
    pc = exact_percentiles(ok, ["bucket"], "create_ms", (0.5, 0.99), ("create_p50", "create_p99"))
    pl = exact_percentiles(ok, ["bucket"], "list_ms", (0.5, 0.99), ("list_p50", "list_p99"))
    j = pc.join(pl, "bucket")
    # the first bucket's two medians, by an aggregate: no task sees all buckets
    one = j.agg(F.min_by(F.struct("create_p50", "list_p50"), "bucket").alias("f")).first()["f"]
    base = one.asDict() if one else {"create_p50": None, "list_p50": None}
    cols = ["create_p50", "create_p99", "list_p50", "list_p99"]

    def ratio(c: str) -> F.Column:
        return F.round(F.col(c) / F.lit(base[c]).cast("double"), 6).alias(f"{c}_ratio")

    return j.select("bucket", *[F.round(c, 6).alias(c) for c in cols], ratio("create_p50"), ratio("list_p50"))


def systematic_sample(created: DataFrame, every: int = SAMPLE_EVERY) -> DataFrame:
    """Every N-th event of a phase and the phase's last event."""
    last = created.groupBy("phase").agg(F.max("iteration").alias("_last"))
    j = created.join(F.broadcast(last), "phase")  # one row per phase
    return j.filter((F.col("iteration") % every == 0) | (F.col("iteration") == F.col("_last"))) \
        .drop("_last")


def first_failure(created: DataFrame) -> DataFrame:
    """Per phase the first failing event, its position and message, and
    what was created before it; phases without failure report nulls."""
    fails = created.filter(F.col("event") == "create_failed")
    ff = fails.groupBy("phase").agg(F.min_by(F.struct("iteration", "error", "created_so_far"),
                                             F.col("iteration")).alias("f"))
    phases = created.select("phase").distinct()
    return phases.join(ff, "phase", "left").select(
        "phase", F.col("f.iteration").alias("fail_iteration"), F.col("f.error").alias("error"),
        F.col("f.created_so_far").alias("created_before"))


# ------------------------------------------------------- G6, G7, G8, G9

def plan_compare(log: DataFrame, plans: Sequence[str] = ("plain", "partitioned")) -> DataFrame:
    """p50/p95/p99 per query, one column per layout, p50 speed-up."""
    pct = exact_percentiles(log, ["query", "plan"], "latency_ms", (0.5, 0.95, 0.99),
                            ("p50", "p95", "p99"))
    wide = pct.groupBy("query").pivot("plan", list(plans)).agg(
        F.first("p50").alias("p50"), F.first("p95").alias("p95"), F.first("p99").alias("p99"))
    cols = [f"{p}_{m}" for p in plans for m in ("p50", "p95", "p99")]
    a, b = plans[0], plans[1]
    return wide.select("query", *[F.round(c, 6).alias(c) for c in cols],
                       F.round(F.col(f"{a}_p50") / F.col(f"{b}_p50"), 6).alias("speedup_p50"))


def field_values(corpus: DataFrame, fields: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """*keys, field, value, rows: the counted values of each field (nulls left out). Counts add up,
    so the profiles of two parts of a corpus merge into that of the whole."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    return (corpus.select(*keys, F.explode(pairs).alias("_p")).select(*keys, "_p.*").filter("value is not null")
            .groupBy(*keys, "field", "value").agg(F.count(F.lit(1)).alias("rows")))


def dataset_profile(corpus: DataFrame, fields: Sequence[str] = ("kbId", "study", "site",
                                                                "patient", "visit"),
                    approx: bool = False) -> DataFrame:
    """Rows, distinct documents, sorted distinct values per scalar field.

    Values are counted per (field, value) first, so the last step reads one row per value (the
    lists are as long as each field's cardinality). ``approx=True`` counts documents with a
    HyperLogLog sketch instead of an exact distinct.
    """
    if approx:
        docs = corpus.agg(F.approx_count_distinct("documentId", 0.01).alias("documents"))
    else:
        docs = corpus.select("documentId").distinct().agg(F.count("documentId").alias("documents"))
    total = corpus.agg(F.count(F.lit(1)).alias("rows")).first()["rows"]
    return _assemble(field_values(corpus, fields), total, docs.first()["documents"], fields)


def _assemble(values: DataFrame, rows: int, documents: int, fields: Sequence[str]) -> DataFrame:
    per = values.groupBy("field").agg(F.array_join(F.sort_array(F.collect_set("value")), ",").alias("v"),
                                      F.count_distinct("value").alias("n"))

    def of(f: str, c: str) -> F.Column:
        return F.max(F.when(F.col("field") == f, F.col(c)))

    return per.agg(F.lit(int(rows)).cast("long").alias("rows"), F.lit(int(documents)).cast("long").alias("documents"),
                   *[F.coalesce(of(f, "v"), F.lit("")).alias(f"{f}_values") for f in fields],
                   *[F.coalesce(of(f, "n"), F.lit(0)).alias(f"{f}_n") for f in fields])


def write_profile(corpus: DataFrame, path: str, part: str,
                  fields: Sequence[str] = ("kbId", "study", "site", "patient", "visit")) -> None:
    """G7 kept up to date: what one part (batch) of a corpus adds to its profile.

    Stored are mergeable pieces: counted values, and per kbId the rows and a HyperLogLog sketch
    of the documents. A part that is written again replaces itself.
    """
    folder = path.rstrip("/")
    field_values(corpus, fields).write.mode("overwrite").parquet(f"{folder}/values/part={part}")
    (corpus.groupBy("kbId").agg(F.count(F.lit(1)).alias("rows"), F.hll_sketch_agg("documentId", PROFILE_LG_K).alias("docs"))
     .write.mode("overwrite").parquet(f"{folder}/rows/part={part}"))


def read_profile(spark, path: str, fields: Sequence[str] = ("kbId", "study", "site", "patient", "visit")) -> DataFrame:
    """The profile of all parts under ``path``: as :func:`dataset_profile`, documents estimated
    from the merged sketches."""
    folder = path.rstrip("/")
    rows = spark.read.parquet(f"{folder}/rows")
    r = rows.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
                 F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("docs")), F.lit(0)).alias("documents")).first()
    return _assemble(spark.read.parquet(f"{folder}/values"), r["rows"], r["documents"], fields)


# Size of the document sketch: 2**14 registers, an error of about one per cent.
PROFILE_LG_K = 14


def skew_profile(corpus: DataFrame, key: str = "kbId", alpha: float = 1.0) -> DataFrame:
    """Rows and share per key, rank by rows, expected Zipf share at that
    rank, and hot / middle / cold tiers. Frames run over the per-key table."""
    counts = corpus.groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
    allw = Window.partitionBy()
    byrows = Window.orderBy(F.col("rows").desc(), F.col(key).asc())
    r = counts.withColumn("rank", F.row_number().over(byrows).cast("long")) \
        .withColumn("_tot", F.sum("rows").over(allw)) \
        .withColumn("_k", F.count(F.lit(1)).over(allw))
    w = F.lit(1.0) / F.pow(F.col("rank").cast("double"), F.lit(float(alpha)))
    r = r.withColumn("_w", w).withColumn("_h", F.sum("_w").over(allw))
    tier = (F.when(F.col("rank") == 1, "hot")
            .when(F.col("rank") == F.col("_k"), "cold")
            .when(F.col("rank") == F.floor(F.col("_k") / 2) + 1, "middle")
            .otherwise("other"))
    return r.select(key, "rows", F.round(F.col("rows") / F.col("_tot"), 6).alias("share"), "rank",
                    F.round(F.col("_w") / F.col("_h"), 6).alias("expected_share"),
                    tier.alias("tier"))


# Fixed value: mean chunks per document of U{20..500}, used to estimate the
# document count when it is not known.
MEAN_CHUNKS_PER_DOC = 260


def chunks_per_document(chunks: DataFrame, doc_col: str = "documentId") -> DataFrame:
    """Documents, rows, min / max / mean chunks per document, and the
    estimate rows div 260 used when the document count is unknown."""
    per = chunks.groupBy(doc_col).agg(F.count(F.lit(1)).alias("n"))
    out = per.agg(F.count(F.lit(1)).alias("documents"), F.sum("n").cast("long").alias("rows"),
                  F.min("n").alias("min_chunks"), F.max("n").alias("max_chunks"),
                  F.round(F.avg("n"), 6).alias("mean_chunks"))
    return out.withColumn("estimated_documents",
                          F.floor(F.col("rows") / MEAN_CHUNKS_PER_DOC).cast("long"))
