"""Named workloads: each takes (spark, sf_dir) and returns a DataFrame.

These are the registered queries of ``__spark_entry__``. Searches read the stored
layout and indexes of ``filtra.plans.indexes``, which the first query of a session
builds from the whole tables; query vectors and predicate values are bound from
stored rows. Queries on texts cover every document, with or without a vector.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filtra.config import OUTPUT_FIELDS, TOP_K
from filtra.operators.fusion import rrf
from filtra.operators.search import search
from filtra.operators.topk import attach_fields, topk
from filtra.plans.indexes import layout, sparse_row_table, stored_once, text_index
from filtra.plans.indexes import stored_chunks as chunks_view
from filtra.plans.indexes import stored_texts as texts_view
from filtra.sources.tables import ANCHOR_ID, anchor_row

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}


def register(name: str):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        return fn
    return deco


def _kb_site(a: dict):
    return (F.col("kbId") == a["kbId"]) & (F.col("site") == a["site"])


def sparse_arm(spark, sf_dir: str, k: int = TOP_K, qid_doc: int = ANCHOR_ID,
               fields: Sequence[str] = ("kbId", "site")) -> DataFrame:
    """R5 with one stored document as the query, among the rows that agree with it in ``fields``:
    the stored text index gives the document's weights, its token buckets the postings."""
    ix = text_index(spark, sf_dir)
    q = texts_view(spark, sf_dir).filter(F.col("id") == qid_doc).select(F.col("id").alias("qid"), "content", *fields)
    scores = ix.scores(ix.query_terms(q, keep=("qid", *fields)), same=fields)
    return topk(scores.select("id", "score"), k).select("rank", "id", "score")


def _arms(spark, sf_dir, fields: Sequence[str] = ("kbId", "site")):
    """The corpus, and the dense and the sparse arm of the anchor's query under the same filter."""
    c, a = _anchor(spark, sf_dir)
    return (c, search(c, a["embedding"], _eq(a, *fields), k=TOP_K, fields=()),
            sparse_arm(spark, sf_dir, fields=fields))


@register("q6_hybrid_multi_and")
def q6_hybrid_multi_and(spark: SparkSession, sf_dir: str):
    """Q6 as the workload asks it: both arms under the five-field predicate of Q2."""
    from filtra.config import SCALAR_FIELDS
    _, dense, sparse = _arms(spark, sf_dir, SCALAR_FIELDS)
    fused = rrf([dense, sparse], k=TOP_K)
    return attach_fields(fused, texts_view(spark, sf_dir), OUTPUT_FIELDS).select("rank", "id", "score", *OUTPUT_FIELDS)


@register("hybrid_rrf")
def hybrid_rrf(spark: SparkSession, sf_dir: str):
    """Dense + sparse arms under the same filter, RRF(60), top-10."""
    _, dense, sparse = _arms(spark, sf_dir)
    fused = rrf([dense, sparse], k=TOP_K)
    return attach_fields(fused, texts_view(spark, sf_dir), OUTPUT_FIELDS).select("rank", "id", "score", *OUTPUT_FIELDS)


# ------------------------------------------------------------------ helpers

def _kb_pool():
    from filtra.config import KB_CARD
    from filtra.sources.generator import pool_values
    return pool_values("kbId", KB_CARD)


KB_POOL = _kb_pool()


def _anchor(spark, sf_dir):
    c = chunks_view(spark, sf_dir)
    return c, anchor_row(c)


def _eq(a: dict, *fields):
    cond = None
    for f in fields:
        e = F.col(f) == a[f]
        cond = e if cond is None else cond & e
    return cond


def _dense(c, a, where, fields=OUTPUT_FIELDS, metric="IP", k=TOP_K, semi=None):
    return search(c, a["embedding"], where, k=k, metric=metric, fields=fields, semi=semi)


def q3_id_list(spark, sf_dir, n: int | None = None) -> DataFrame:
    """F8 draw for Q3: n documentIds in md5 order (a seeded sample of documents)."""
    from filtra.config import Q3_LIST_SIZE
    from filtra.operators.predicates import draw_document_ids
    return draw_document_ids(spark, sf_dir, Q3_LIST_SIZE if n is None else n)


# ------------------------------------------------------------- D1, V1-V5

@register("scan_project")
def scan_project(spark, sf_dir):
    """Scan the chunk table keeping the requested output fields."""
    return chunks_view(spark, sf_dir).select("id", "kbId", "documentId")


@register("vec_inner_product")
def vec_inner_product(spark, sf_dir):
    from filtra.functions.vectors import inner_product, vector_literal
    c, a = _anchor(spark, sf_dir)
    return c.select("id", F.round(inner_product("embedding", vector_literal(a["embedding"])), 6)
                    .alias("score"))


@register("vec_l2")
def vec_l2(spark, sf_dir):
    from filtra.functions.vectors import l2_distance, vector_literal
    c, a = _anchor(spark, sf_dir)
    return c.select("id", F.round(l2_distance("embedding", vector_literal(a["embedding"])), 6)
                    .alias("score"))


@register("vec_cosine")
def vec_cosine(spark, sf_dir):
    from filtra.functions.vectors import cosine, vector_literal
    c, a = _anchor(spark, sf_dir)
    return c.select("id", F.round(cosine("embedding", vector_literal(a["embedding"])), 6)
                    .alias("score"))


@register("vec_normalize")
def vec_normalize(spark, sf_dir):
    from filtra.functions.vectors import l2_norm, normalize
    c = chunks_view(spark, sf_dir)
    n = c.select("id", "embedding", normalize("embedding").alias("unit"))
    return n.select(
        "id",
        F.round(l2_norm("embedding"), 6).alias("norm_in"),
        F.round(l2_norm("unit"), 6).alias("norm_out"),
        F.round(F.aggregate("unit", F.lit(0.0).cast("double"),
                            lambda acc, x: acc + x.cast("double")), 6).alias("sum_out"),
        F.size("unit").cast("long").alias("dim"),
    )


@register("sparse_inner_product")
def sparse_inner_product_q(spark, sf_dir):
    """V5 in row form: per text map<token, weight> against the anchor's map."""
    from filtra.functions.vectors import sparse_inner_product
    from filtra.operators.sparse import terms_literal
    rows = sparse_row_table(spark, sf_dir)
    own = rows.filter(F.col("id") == ANCHOR_ID).select(F.explode("vec").alias("token", "qweight"))
    # a map is scored where it is read; only its score moves
    scored = rows.select("id", sparse_inner_product("vec", terms_literal(own)).alias("s"))
    s = texts_view(spark, sf_dir).select("id").join(scored, "id", "left")
    return s.select("id", F.round(F.coalesce("s", F.lit(0.0)), 6).alias("score"))


# ----------------------------------------------------- R1, F1-F6, F12

@register("filtered_topk")
def filtered_topk(spark, sf_dir):
    """kbId + site filter, exact IP top-10 with output fields."""
    c, a = _anchor(spark, sf_dir)
    return _dense(c, a, _kb_site(a))


@register("q1_single_eq")
def q1_single_eq(spark, sf_dir):
    c, a = _anchor(spark, sf_dir)
    return _dense(c, a, _eq(a, "kbId", "study"))


@register("q2_multi_and")
def q2_multi_and(spark, sf_dir):
    c, a = _anchor(spark, sf_dir)
    return _dense(c, a, _eq(a, "kbId", "study", "site", "patient", "visit"))


@register("q3_document_in")
def q3_document_in(spark, sf_dir):
    c, a = _anchor(spark, sf_dir)
    ids = q3_id_list(spark, sf_dir)
    return _dense(c, a, _eq(a, "kbId"), semi=(F.broadcast(ids), "documentId"))


@register("q3_long_list")
def q3_long_list(spark, sf_dir):
    """F3 with half of all documents in the list: corpus and list are bucketed alike by documentId,
    so the semi join moves no corpus row."""
    from filtra.operators.predicates import in_list
    from filtra.plans.indexes import bucketed_chunks
    c, a = _anchor(spark, sf_dir)
    ids = texts_view(spark, sf_dir).select("documentId").filter(
        F.substring(F.md5(F.concat(F.lit("44:"), "documentId")), 1, 1) < "8")
    rows = in_list(bucketed_chunks(spark, sf_dir), ids, "documentId")
    return search(rows, a["embedding"], _eq(a, "kbId"), k=TOP_K)


@register("q7_kb_in")
def q7_kb_in(spark, sf_dir):
    c, a = _anchor(spark, sf_dir)
    kbs = [KB_POOL[0], KB_POOL[len(KB_POOL) // 2], KB_POOL[-1]]
    return _dense(c, a, F.col("kbId").isin(kbs))


@register("q7_no_filter")
def q7_no_filter(spark, sf_dir):
    c, a = _anchor(spark, sf_dir)
    return _dense(c, a, None)


@register("q7_one_kb")
def q7_one_kb(spark, sf_dir):
    c, a = _anchor(spark, sf_dir)
    return _dense(c, a, F.col("kbId") == KB_POOL[0])


@register("q5_scalar_only")
def q5_scalar_only(spark, sf_dir):
    """Q2 predicate, no vector, 100 rows in id order."""
    c, a = _anchor(spark, sf_dir)
    return (c.filter(_eq(a, "kbId", "study", "site", "patient", "visit"))
            .select("id", "kbId", "documentId").orderBy("id").limit(100))


@register("output_fields")
def output_fields(spark, sf_dir):
    """rank on (id, vector) only, then join the hits' fields back by id."""
    c, a = _anchor(spark, sf_dir)
    hits = _dense(c, a, _kb_site(a), fields=())
    fields = ["documentId", "kbId", "study", "site", "patient", "visit", "content"]
    return attach_fields(hits, c, fields, max_hits=TOP_K).select("rank", "id", "score", *fields)


@register("vec_l2_topk")
def vec_l2_topk(spark, sf_dir):
    """R1 under the L2 metric (ascending distance)."""
    c, a = _anchor(spark, sf_dir)
    return _dense(c, a, _kb_site(a), metric="L2")


@register("vec_cosine_topk")
def vec_cosine_topk(spark, sf_dir):
    c, a = _anchor(spark, sf_dir)
    return _dense(c, a, _kb_site(a), metric="COSINE")


# ------------------------------------------------------------- R2

def group_queries(c: DataFrame, keys=("kbId", "site")) -> DataFrame:
    """One query per (kbId, site) group: the vector of its lowest-id chunk,
    restricted to the group. Work grows with the corpus; query count with the
    attribute cardinalities."""
    reps = c.groupBy(*keys).agg(F.min("id").alias("qid"))
    vecs = c.select(F.col("id").alias("qid"), F.col("embedding").alias("q_dense"))
    return reps.join(vecs, "qid")


@register("batch_topk")
def batch_topk(spark, sf_dir):
    from filtra.operators.search import search_batch
    c = chunks_view(spark, sf_dir)
    return search_batch(c, group_queries(c), k=TOP_K)


# ---------------------------------------------------- R5, R6, R8

@register("sparse_topk")
def sparse_topk(spark, sf_dir):
    return sparse_arm(spark, sf_dir)


@register("bm25_weights")
def bm25_weights(spark, sf_dir):
    return text_index(spark, sf_dir).weights().withColumn("weight", F.round("weight", 6))


@register("hybrid_weighted")
def hybrid_weighted(spark, sf_dir):
    from filtra.config import WEIGHT_DENSE, WEIGHT_SPARSE
    from filtra.operators.fusion import weighted
    _, dense, sparse = _arms(spark, sf_dir)
    return weighted([(dense, WEIGHT_DENSE), (sparse, WEIGHT_SPARSE)], k=TOP_K)


@register("hybrid_weighted_minmax")
def hybrid_weighted_minmax(spark, sf_dir):
    from filtra.config import WEIGHT_DENSE, WEIGHT_SPARSE
    from filtra.operators.fusion import weighted
    _, dense, sparse = _arms(spark, sf_dir)
    return weighted([(dense, WEIGHT_DENSE), (sparse, WEIGHT_SPARSE)], k=TOP_K, norm="minmax")


# ------------------------------------------------------------- R10, R11

@register("recall_at_k")
def recall_at_k_q(spark, sf_dir):
    """Share of the exact dense top-10 that the RRF hybrid list keeps."""
    from filtra.operators.quality import recall_at_k
    _, dense, sparse = _arms(spark, sf_dir)
    fused = rrf([dense, sparse], k=TOP_K)
    return recall_at_k(dense, fused)


@register("ranker_overlap")
def ranker_overlap_q(spark, sf_dir):
    """Dense vs RRF, and RRF vs weighted: shared / only-left / only-right / Jaccard."""
    from filtra.operators.fusion import weighted
    from filtra.operators.quality import overlap
    _, dense, sparse = _arms(spark, sf_dir)
    fused = rrf([dense, sparse], k=TOP_K)
    wsum = weighted([(dense, 1.0), (sparse, 1.0)], k=TOP_K)
    return overlap(dense, fused, "dense_vs_rrf").unionByName(
        overlap(fused, wsum, "rrf_vs_weighted"))


# ------------------------------------------------------------- G1-G12

def _created(spark, sf_dir):
    from filtra.operators.stats import running_created
    from filtra.sources.tables import event_log_view
    return running_created(event_log_view(spark, sf_dir))


@register("latency_summary")
def latency_summary_q(spark, sf_dir):
    """G1: serial (concurrency 1) latency per query label; every label seen in
    the log is listed, zeros where it has no serial samples."""
    from filtra.operators.stats import latency_summary
    from filtra.sources.tables import request_log_view
    log = request_log_view(spark, sf_dir)
    return latency_summary(log.filter(F.col("concurrency") == 1), ["query"],
                           labels=log.select("query"))


@register("throughput")
def throughput_q(spark, sf_dir):
    from filtra.operators.stats import throughput
    from filtra.sources.tables import request_log_view
    return throughput(request_log_view(spark, sf_dir), ["concurrency"])


@register("phase_summary")
def phase_summary_q(spark, sf_dir):
    from filtra.operators.stats import phase_summary, phase_totals
    from filtra.sources.tables import event_log_view
    return phase_summary(phase_totals(event_log_view(spark, sf_dir)))


@register("growth_rate")
def growth_rate_q(spark, sf_dir):
    from filtra.operators.stats import growth_rate
    return growth_rate(_created(spark, sf_dir))


@register("latency_trend")
def latency_trend_q(spark, sf_dir):
    from filtra.operators.stats import latency_trend
    return latency_trend(_created(spark, sf_dir), step=1000)


@register("plan_compare")
def plan_compare_q(spark, sf_dir):
    from filtra.operators.stats import plan_compare
    from filtra.sources.tables import request_log_view
    return plan_compare(request_log_view(spark, sf_dir))


@register("dataset_profile")
def dataset_profile_q(spark, sf_dir):
    from filtra.operators.stats import dataset_profile
    return dataset_profile(chunks_view(spark, sf_dir))


@register("skew_profile")
def skew_profile_q(spark, sf_dir):
    from filtra.operators.stats import skew_profile
    return skew_profile(chunks_view(spark, sf_dir))


@register("running_created")
def running_created_q(spark, sf_dir):
    return _created(spark, sf_dir).select("phase", "iteration", "event", "created_so_far")


@register("systematic_sample")
def systematic_sample_q(spark, sf_dir):
    from filtra.operators.stats import systematic_sample
    return systematic_sample(_created(spark, sf_dir)).select(
        "phase", "iteration", "event", "created_so_far", "create_ms", "list_ms")


@register("first_failure")
def first_failure_q(spark, sf_dir):
    from filtra.operators.stats import first_failure
    return first_failure(_created(spark, sf_dir))


def _study(spark, sf_dir):
    """The creation log as a study that stops each phase at its first failure leaves it."""
    from filtra.operators.stats import until_failure
    from filtra.sources.tables import event_log_view
    return until_failure(event_log_view(spark, sf_dir))


@register("study_phases")
def study_phases_q(spark, sf_dir):
    """G3 under G12: nothing after a phase's first failure counts."""
    from filtra.operators.stats import phase_summary, phase_totals
    return phase_summary(phase_totals(_study(spark, sf_dir)))


@register("study_created")
def study_created_q(spark, sf_dir):
    """G10 under G12: the success counter at every event that counts."""
    from filtra.operators.stats import running_created
    return running_created(_study(spark, sf_dir)).select("phase", "iteration", "event", "created_so_far")


@register("study_growth")
def study_growth_q(spark, sf_dir):
    """G4 under G12."""
    from filtra.operators.stats import growth_rate, running_created
    return growth_rate(running_created(_study(spark, sf_dir)))


@register("study_trend")
def study_trend_q(spark, sf_dir):
    """G5 under G12, in buckets of ten."""
    from filtra.operators.stats import latency_trend, running_created
    return latency_trend(running_created(_study(spark, sf_dir)), step=10)


# ------------------------------------------------------ generator (D*)

def _gen(spark, sf_dir, vectors=False):
    from filtra.sources.generator import generated_chunks
    return generated_chunks(spark, sf_dir, with_vectors=vectors)


@register("zipf_assign")
def zipf_assign_q(spark, sf_dir):
    """D3: Zipf(1.0) draws of the five attributes for every document."""
    from filtra.config import PoolSpec
    from filtra.sources.generator import zipf_assign
    from filtra.sources.tables import read_table
    d = read_table(spark, sf_dir, "documents").select("doc_id")
    return d.select("doc_id", *[zipf_assign("doc_id", f, card).alias(f)
                                for f, card in PoolSpec().as_dict().items()])


@register("chunk_expand")
def chunk_expand_q(spark, sf_dir):
    """Documents -> 20..500 chunks each, contiguous ids, shared attributes."""
    return _gen(spark, sf_dir)


@register("dense_vectors")
def dense_vectors_q(spark, sf_dir):
    """An 8-dim unit vector per document, by its length and norm (the draws are Spark's own hash)."""
    from filtra.functions.vectors import l2_norm
    from filtra.sources.generator import dense_vectors
    from filtra.sources.tables import read_table
    d = read_table(spark, sf_dir, "documents").select("doc_id")
    v = d.select("doc_id", dense_vectors("doc_id", 8).alias("embedding"))
    return v.select("doc_id", F.size("embedding").cast("long").alias("dim"),
                    F.round(l2_norm("embedding"), 6).alias("norm"))


@register("sparse_vectors")
def sparse_vectors_q(spark, sf_dir):
    """64 distinct token ids of 30000 with weights per document, a row per entry."""
    from filtra.sources.generator import sparse_vectors
    from filtra.sources.tables import read_table
    d = read_table(spark, sf_dir, "documents").select("doc_id")
    v = d.select("doc_id", F.explode(sparse_vectors("doc_id")).alias("token", "w"))
    return v.select("doc_id", F.col("token").cast("long").alias("token"),
                    F.round(F.col("w").cast("double"), 6).alias("weight"))


@register("query_set")
def query_set_q(spark, sf_dir):
    """Queries from the second seed, one per stored vector: the dense vector by its length and
    norm, the sparse one entry by entry."""
    from filtra.functions.vectors import l2_norm
    from filtra.sources.generator import query_set
    from filtra.sources.tables import read_table
    e = read_table(spark, sf_dir, "embeddings").select("vec_id")
    q = query_set(e, "vec_id", dim=64)
    return q.select("qid", F.size("q_dense").cast("long").alias("dim"), F.round(l2_norm("q_dense"), 6).alias("norm"),
                    F.explode("q_sparse").alias("token", "w")).select(
        "qid", "dim", "norm", F.col("token").cast("long").alias("token"),
        F.round(F.col("w").cast("double"), 6).alias("weight"))


@register("content_template")
def content_template_q(spark, sf_dir):
    """The placeholder content on every text."""
    from filtra.sources.generator import with_content
    c = texts_view(spark, sf_dir).select("id")
    return with_content(c, 256)


@register("chunks_per_document")
def chunks_per_document_q(spark, sf_dir):
    from filtra.operators.stats import chunks_per_document
    return chunks_per_document(_gen(spark, sf_dir))


@register("skew_profile_generated")
def skew_profile_generated_q(spark, sf_dir):
    """G8 on the Zipf-skewed generated corpus."""
    from filtra.operators.stats import skew_profile
    return skew_profile(_gen(spark, sf_dir))


@register("chunk_hits_by_document")
def chunk_hits_by_document_q(spark, sf_dir):
    """Chunks matched per document for the Q3 IN list of 100 documents."""
    from filtra.operators.quality import chunk_hits_by_document
    ids = q3_id_list(spark, sf_dir)
    return chunk_hits_by_document(_gen(spark, sf_dir), F.broadcast(ids))


# ------------------------------------------- layouts and sinks

@register("partitioned_layout")
def partitioned_layout_q(spark, sf_dir):
    """Write the corpus by kbId and by hash bucket; row counts per kbId read
    back from each layout must agree with the source."""
    a = layout(spark, sf_dir, "kbId").groupBy("kbId").agg(F.count(F.lit(1)).alias("rows_by_kb"))
    b = layout(spark, sf_dir, "bucket").groupBy("kbId").agg(
        F.count(F.lit(1)).alias("rows_by_bucket"))
    return a.join(b, "kbId", "full")


@register("partitioned_topk")
def partitioned_topk_q(spark, sf_dir):
    """R1 on the kbId-partitioned layout: only the anchor's kb directory is
    read (PartitionFilters), same answer as on the plain table."""
    from filtra.sources.sinks import key_filter
    lay = layout(spark, sf_dir, "kbId")
    a = anchor_row(lay)
    where = key_filter(a["kbId"]) & (F.col("site") == a["site"])
    return search(lay, a["embedding"], where, k=TOP_K, fields=OUTPUT_FIELDS)


@register("partitioned_topk_bucket")
def partitioned_topk_bucket_q(spark, sf_dir):
    """R9 on the hash-bucket layout; the derived bucket predicate prunes."""
    from filtra.sources.sinks import key_filter
    lay = layout(spark, sf_dir, "bucket")
    a = anchor_row(lay)
    where = key_filter(a["kbId"], by="bucket") & (F.col("site") == a["site"])
    return search(lay, a["embedding"], where, k=TOP_K, fields=OUTPUT_FIELDS)


@register("schema_validate")
def schema_validate_q(spark, sf_dir):
    """Rejected chunks with their reasons (content over 2048 characters,
    wrong vector length, nulls, duplicate ids)."""
    from filtra.operators.validate import validate
    good, bad = validate(texts_view(spark, sf_dir), dim=64)
    return bad.select("id", "reasons")


@register("sink_manifest")
def sink_manifest_q(spark, sf_dir):
    """The dataset profile and the run's settings written as a JSON manifest and read back."""
    from filtra.operators.stats import dataset_profile
    from filtra.session import scratch_path
    from filtra.sources.sinks import read_manifest, run_settings, write_manifest
    prof = dataset_profile(chunks_view(spark, sf_dir))
    path = scratch_path(spark, "manifest")
    write_manifest(prof, path, extra=run_settings(dim=64))
    return read_manifest(spark, path, prof.schema)


@register("sink_results_csv")
def sink_results_csv_q(spark, sf_dir):
    """Latency summary rows appended to a CSV result file and read back."""
    from filtra.session import scratch_path
    from filtra.sources.sinks import append_results, read_results
    rows = QUERIES["latency_summary"](spark, sf_dir)
    path = scratch_path(spark, "results-csv")
    append_results(rows, path)
    return read_results(spark, path, rows.schema.simpleString()[len("struct<"):-1]
                        .replace(":", " "))


@register("sink_modes")
def sink_modes_q(spark, sf_dir):
    """A second write to the same target is refused; with replacement it
    succeeds. Returns the table as read back after the replacing write."""
    from pyspark.errors import AnalysisException
    from filtra.session import scratch_path
    from filtra.sources.sinks import write_table
    src = chunks_view(spark, sf_dir).select("id", "kbId")
    path = scratch_path(spark, "modes")
    write_table(src, path)
    try:
        write_table(src, path)
        raise AssertionError("write over an existing target was not refused")
    except AnalysisException:
        pass
    write_table(src, path, replace=True)
    return spark.read.parquet(path)


# ------------------------------------------------- F7-F11: predicates as data

N_PREDICATES = 20


def _drawn_predicates(c):
    """20 predicates from stored rows: kbId and site fixed, other fields open."""
    from filtra.operators.predicates import draw_rows
    p = draw_rows(c, N_PREDICATES)
    return p.select("qid", "kbId", F.lit(None).cast("string").alias("study"), "site",
                    F.lit(None).cast("string").alias("patient"),
                    F.lit(None).cast("string").alias("visit"))


@register("predicate_draw")
def predicate_draw_q(spark, sf_dir):
    """F8: 20 predicate rows drawn (seeded, md5 order) from stored chunks."""
    from filtra.operators.predicates import draw_rows
    return draw_rows(chunks_view(spark, sf_dir), N_PREDICATES)


@register("predicate_table")
def predicate_table_q(spark, sf_dir):
    """every chunk matching each of the 20 drawn predicates, one job."""
    from filtra.operators.predicates import batch_filter
    c = chunks_view(spark, sf_dir)
    return batch_filter(c, _drawn_predicates(c))


@register("hit_count")
def hit_count_q(spark, sf_dir):
    """hits and share per drawn predicate (zero-hit predicates kept)."""
    from filtra.operators.predicates import hit_count
    c = chunks_view(spark, sf_dir)
    return hit_count(c, _drawn_predicates(c))


@register("predicate_batch_topk")
def predicate_batch_topk_q(spark, sf_dir):
    """R2 with the drawn predicates: each predicate searched with the vector of
    the row it was drawn from (wildcards handled inside the kernel)."""
    from filtra.operators.predicates import draw_rows
    from filtra.operators.search import search_batch
    c = chunks_view(spark, sf_dir)
    p = draw_rows(c, N_PREDICATES)
    q = p.join(c.select(F.col("id").alias("source_id"), F.col("embedding").alias("q_dense")),
               "source_id").select("qid", "q_dense", "kbId", "site")
    return search_batch(c, q, k=TOP_K)


@register("q7_hot_mid_cold")
def q7_hot_mid_cold_q(spark, sf_dir):
    """KBs ranked by measured rows; for the hot, middle and cold one, the
    Q2-style five-field predicate of that KB's lowest-id chunk, searched with
    the anchor vector."""
    from filtra.operators.predicates import kb_tiers
    from filtra.operators.search import search_batch
    c, a = _anchor(spark, sf_dir)
    tiers = kb_tiers(c)
    reps = c.groupBy("kbId").agg(F.min("id").alias("rep_id"))
    preds = tiers.join(reps, "kbId").join(
        c.select(F.col("id").alias("rep_id"), "study", "site", "patient", "visit"), "rep_id")
    q = preds.select(F.col("pos").cast("long").alias("qid"), "tier", "kbId", "study", "site",
                     "patient", "visit").withColumn("q_dense", vector_col(a["embedding"]))
    res = search_batch(c, q, k=TOP_K)
    return res.join(F.broadcast(q.select("qid", "tier")), "qid")  # three rows


def vector_col(v):
    from filtra.functions.vectors import vector_literal
    return vector_literal(v).cast("array<float>")


@register("q4_hit_rate_scan")
def q4_hit_rate_scan_q(spark, sf_dir):
    """for target hit rates 0.01/0.1/1/10/30 %, the kb-anchored predicate
    with the nearest measured rate, then top-10 under it (anchor vector)."""
    from filtra.config import HIT_RATE_TARGETS_PCT
    from filtra.operators.predicates import hit_rate_candidates, nearest_to_targets
    from filtra.operators.search import search_batch
    c, a = _anchor(spark, sf_dir)
    best = nearest_to_targets(hit_rate_candidates(c), HIT_RATE_TARGETS_PCT)
    w = F.row_number().over(Window.orderBy("target_pct"))  # five rows
    q = best.withColumn("qid", w.cast("long")).withColumn("q_dense", vector_col(a["embedding"]))
    res = search_batch(c, q.select("qid", "q_dense", "kbId", "study", "site", "patient", "visit"),
                       k=TOP_K, fields=())
    meta = q.select("qid", "target_pct", F.round("rate_pct", 6).alias("rate_pct"), "hits")
    return res.join(F.broadcast(meta), "qid").drop("qid")


# ------------------------------------------------------------- R3, R4

IVF_NLIST_FIXTURE = 16


def ivf_index(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The stored IVF index of the chunk table and its centres, built once per data set."""
    from filtra.operators.ivf import ivf_build, write_ivf_index

    def write(path: str) -> None:
        index, cents = ivf_build(chunks_view(spark, sf_dir).drop("content"), IVF_NLIST_FIXTURE)
        write_ivf_index(index, f"{path}/rows")
        cents.write.parquet(f"{path}/centres")

    path = stored_once(spark, sf_dir, "ivf-index", write)
    return spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/centres")


def _ivf(spark, sf_dir):
    return (chunks_view(spark, sf_dir), *ivf_index(spark, sf_dir))


def _hit_checks(c: DataFrame, qs: DataFrame, hits: DataFrame) -> DataFrame:
    """qid, hits, in_group, exact, ranked, own: what any result of the group queries must satisfy."""
    from filtra.functions.vectors import score_expr
    rows = c.select("id", F.col("kbId").alias("_kb"), F.col("site").alias("_site"), "embedding")
    j = hits.select("qid", "rank", "id", "score").join(rows, "id").join(qs, "qid")
    before = Window.partitionBy("qid").orderBy("rank")
    j = j.withColumn("sorted", (F.col("rank") == F.row_number().over(before))
                     & F.coalesce((F.lag("score").over(before) > F.col("score"))
                                  | ((F.lag("score").over(before) == F.col("score"))
                                     & (F.lag("id").over(before) < F.col("id"))), F.lit(True)))
    return j.groupBy("qid").agg(
        F.count(F.lit(1)).alias("hits"),
        F.bool_and((F.col("_kb") == F.col("kbId")) & (F.col("_site") == F.col("site"))).alias("in_group"),
        F.bool_and(F.abs(F.col("score") - score_expr("IP", "embedding", F.col("q_dense"))) < 2e-6).alias("exact"),
        F.bool_and("sorted").alias("ranked"), F.bool_or(F.col("id") == F.col("qid")).alias("own"))


@register("ivf_build")
def ivf_build_q(spark, sf_dir):
    """Every chunk with its IVF cell; the cell's centre is the nearest of all."""
    from filtra.functions.vectors import l2_distance
    from filtra.operators.blocked import search_blocked
    _, index, cents = _ivf(spark, sf_dir)
    near = search_blocked(cents.select(F.col("cell").cast("long").alias("id"), F.col("center").alias("embedding")),
                          index.select(F.col("id").alias("qid"), F.col("embedding").alias("q_dense")),
                          k=1, metric="L2", fields=(), pred_fields=()).select(F.col("qid").alias("id"),
                                                                              F.col("score").alias("best"))
    own = index.join(F.broadcast(cents), "cell", "left")  # one centre a cell
    return own.join(near, "id", "left").select(
        "id", F.col("center").isNotNull().alias("known_cell"),
        (l2_distance("embedding", "center") <= F.col("best") + 2e-6).alias("nearest"))


@register("ivf_search")
def ivf_search_q(spark, sf_dir):
    """R4 with nprobe = nlist: must equal the exact batch search (batch_topk)."""
    from filtra.operators.ivf import ivf_search
    c, index, cents = _ivf(spark, sf_dir)
    return ivf_search(index, cents, group_queries(c), nprobe=IVF_NLIST_FIXTURE, k=TOP_K)


@register("ivf_search_nprobe4")
def ivf_search_nprobe4_q(spark, sf_dir):
    """R4 approximate (4 of 16 cells probed): per query, whether its hits are rows of its group
    with exact scores and gapless ranks, its own row among them. ``ivf_recall`` says how many
    of the exact hits are found, ``ivf_search_bounded`` finds them all."""
    from filtra.operators.ivf import ivf_search
    c, index, cents = _ivf(spark, sf_dir)
    qs = group_queries(c)
    hits = ivf_search(index, cents, qs, nprobe=4, k=TOP_K, fields=())
    return _hit_checks(c, qs, hits).drop("hits")


# ------------------------------------------------------------- T1-T3

def _land(df: DataFrame, name: str, slices: Sequence | None = None, slice_col: str | None = None):
    """Stage rows derived from the driver tables as files of a landing folder
    (one write per slice, in order, so file times follow the slice order)."""
    from filtra.session import scratch_path
    path = scratch_path(df.sparkSession, name)
    if slices is None:
        df.write.parquet(path)
    else:
        for s in slices:
            df.filter(F.col(slice_col) == s).drop(slice_col).write.mode("append").parquet(path)
    return path


LANDING_FILES = 8  # at least


def _ingested(spark, sf_dir) -> tuple[str, str, str]:
    """Folders of good rows, rejects and rates after an ingest of the chunk files, of which the
    last to arrive repeat every tenth id; a second run on the same checkpoint (resume) adds
    nothing."""
    from filtra.session import scratch_path
    from filtra.streaming.ingest import stream_ingest
    from filtra.plans.indexes import chunk_bytes
    from filtra.sources.sinks import writers
    c = chunks_view(spark, sf_dir)
    again, mean = c.filter(F.col("id") % 10 == 0), chunk_bytes(spark, sf_dir)
    # files follow the bytes, so that no task writes, or reads in a batch, more than a few of them
    src = _land(c.repartition(max(LANDING_FILES, writers(c, mean)), "id"), "landing-chunks")
    again.repartition(writers(again, mean), "id").write.mode("append").parquet(src)
    folders = [scratch_path(spark, n) for n in ("ingested", "rejects", "rates")]
    ck = scratch_path(spark, "ingest-ck")
    for _ in range(2):
        stream_ingest(spark, src, folders[0], ck, c.schema, dim=64, rejects_dir=folders[1], unique="id",
                      rates_dir=folders[2])
    return tuple(folders)


@register("stream_ingest")
def stream_ingest_q(spark, sf_dir):
    """Chunk files ingested two per trigger, validated row by row and against the ids seen
    before: the good rows, and the rejects with their reasons."""
    good, bad, _ = _ingested(spark, sf_dir)
    cols = ["id", "kbId", "documentId"]
    return spark.read.parquet(good).select(*cols, F.lit("").alias("reasons")).unionByName(
        spark.read.parquet(bad).select(*cols, "reasons"))


@register("ingest_rate")
def ingest_rate_q(spark, sf_dir):
    """What the ingest of T1 read, kept and rejected, and whether every batch has a rate."""
    from filtra.streaming.ingest import ingest_rate
    rates = ingest_rate(spark.read.parquet(_ingested(spark, sf_dir)[2]))
    return rates.agg(F.sum(F.when(F.col("batch").isNotNull(), F.col("rows_in"))).alias("rows_in"),
                     F.max(F.when(F.col("batch").isNull(), F.col("rows_in"))).alias("total_in"),
                     F.max(F.when(F.col("batch").isNull(), F.col("rows_kept"))).alias("total_kept"),
                     F.bool_and((F.col("rows_per_s") > 0) | (F.col("rows_in") == 0)).alias("rated"))


@register("stream_latency_qps")
def stream_latency_qps_q(spark, sf_dir):
    """The request log arriving in four time-ordered slices; per day and
    query label: requests, QPS and p50/p99 latency, closed windows only."""
    from filtra.session import scratch_path
    from filtra.sources.tables import request_log_view
    from filtra.streaming.monitor import latency_counts, latency_windows
    log = request_log_view(spark, sf_dir)
    span = log.agg(F.min(F.unix_seconds("ts")).alias("a"), F.max(F.unix_seconds("ts")).alias("b")).first()
    first, width = span["a"] or 0, ((span["b"] or 0) - (span["a"] or 0)) // 4 + 1
    sliced = log.withColumn("_s", F.floor((F.unix_seconds("ts") - F.lit(first)) / F.lit(width)))
    src = _land(sliced, "landing-requests", slices=[0, 1, 2, 3], slice_col="_s")  # quarters of the log's span
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 64).parquet(src)
    out, ck = scratch_path(spark, "latency-counts"), scratch_path(spark, "latency-ck")
    q = (latency_counts(stream).writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", ck).outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return latency_windows(spark.read.parquet(out))


@register("stream_search")
def stream_search_q(spark, sf_dir):
    """The (kbId, site) group queries arriving as a stream, one file per
    trigger; answers equal the batch search."""
    from filtra.session import scratch_path
    from filtra.streaming.search import stream_search
    c = chunks_view(spark, sf_dir)
    qs = group_queries(c)
    src = _land(qs.repartition(4, "qid"), "landing-queries")
    sink, ck = scratch_path(spark, "answers"), scratch_path(spark, "answers-ck")
    stream_search(spark, c, src, qs.schema, sink, ck, k=TOP_K)
    return spark.read.parquet(sink).drop("batch")


@register("ivf_search_widen")
def ivf_search_widen_q(spark, sf_dir):
    """R4 starting at 4 of 16 cells and widening until each filtered query has k hits or all cells
    are probed: as many hits as exact search has, each checked as in ``ivf_search_nprobe4``."""
    from filtra.operators.ivf import ivf_search_widening
    c, index, cents = _ivf(spark, sf_dir)
    qs = group_queries(c)
    return _hit_checks(c, qs, ivf_search_widening(index, cents, qs, nprobe=4, k=TOP_K, fields=())).drop("own")


@register("generated_batch_topk")
def generated_batch_topk_q(spark, sf_dir):
    """R2 at corpus scale: the 1:N generated corpus (20-500 chunks per document,
    Zipf-skewed kbId, 8-dim vectors); one query per kbId (its lowest-id chunk's
    vector), restricted to that kbId. Rows only: the vectors are xxhash-based."""
    from filtra.operators.blocked import search_blocked
    g = _gen(spark, sf_dir, vectors=True).select("id", "kbId", "documentId", "study", "site",
                                                  "patient", "visit", "embedding")
    from filtra.sources.generator import dense_vectors
    reps = g.groupBy("kbId").agg(F.min("id").alias("qid"))
    # a stored vector is a function of its id: rebuild the ten query vectors
    # from their ids instead of joining them out of the whole corpus
    q = reps.withColumn("q_dense", dense_vectors("qid", 8))
    hits = search_blocked(g, q, k=TOP_K, fields=("kbId",))
    return hits.groupBy("qid", "kbId").agg(
        F.count(F.lit(1)).alias("hits"), F.min_by("id", "rank").alias("best_id"),
        F.min_by("score", "rank").alias("best_score"),
        ((F.min("rank") == 1) & (F.max("rank") == F.count(F.lit(1)))).alias("ranked"))


@register("q7_hot_mid_cold_pool")
def q7_hot_mid_cold_pool_q(spark, sf_dir):
    """F9 by pool position (kb_00, kb_05, kb_09): each KB's lowest-id chunk
    gives the Q2-style predicate, searched with the anchor vector."""
    from filtra.operators.predicates import kb_pool_tiers
    from filtra.operators.search import search_batch
    c, a = _anchor(spark, sf_dir)
    tiers = spark.createDataFrame(kb_pool_tiers(KB_POOL), "tier string, pos int, kbId string")
    reps = c.groupBy("kbId").agg(F.min("id").alias("rep_id"))
    preds = F.broadcast(tiers).join(reps, "kbId").join(
        c.select(F.col("id").alias("rep_id"), "study", "site", "patient", "visit"), "rep_id")
    q = preds.select(F.col("pos").cast("long").alias("qid"), "tier", "kbId", "study", "site",
                     "patient", "visit").withColumn("q_dense", vector_col(a["embedding"]))
    res = search_batch(c, q, k=TOP_K)
    return res.join(F.broadcast(q.select("qid", "tier")), "qid")


def ivf_recall_rows(spark, sf_dir) -> DataFrame:
    """qid, k, found, recall of 4-of-16-cell search per query, and of all as qid = -1."""
    from filtra.operators.ivf import ivf_search
    from filtra.operators.quality import recall_at_k
    from filtra.operators.search import search_batch
    c, index, cents = _ivf(spark, sf_dir)
    qs = group_queries(c)
    exact = search_batch(c, qs, k=TOP_K, fields=())
    approx = ivf_search(index, cents, qs, nprobe=4, k=TOP_K, fields=())
    per = recall_at_k(exact, approx, keys=["qid"])
    mean = per.agg(F.lit(-1).cast("long").alias("qid"), F.sum("k").alias("k"),
                   F.sum("found").alias("found"), F.round(F.avg("recall"), 6).alias("recall"))
    return per.unionByName(mean)


@register("ivf_recall")
def ivf_recall_q(spark, sf_dir):
    """R10 on IVF: recall@10 per query of 4-of-16-cell search against exact search, the mean as
    qid = -1: that some exact hits are found and the share is found / k."""
    return ivf_recall_rows(spark, sf_dir).select(
        "qid", "k", (F.col("found") > 0).alias("some"), F.col("recall").between(0.0, 1.0).alias("share"))


# ------------------------------------------------ stored index layouts

@register("sparse_topk_stored")
def sparse_topk_stored_q(spark, sf_dir):
    """R5 over weighted postings stored by token bucket (only the query's buckets are read)."""
    from filtra.operators.sparse import query_terms, sparse_search, write_postings
    path = stored_once(spark, sf_dir, "weighted-postings", lambda p: write_postings(
        text_index(spark, sf_dir).weights(), p))
    stored = spark.read.parquet(path)
    c, a = _anchor(spark, sf_dir)
    return sparse_search(stored, query_terms(stored, ANCHOR_ID), k=TOP_K,
                         allowed_ids=texts_view(spark, sf_dir).filter(_kb_site(a)))


@register("ivf_search_stored")
def ivf_search_stored_q(spark, sf_dir):
    """R4 over an IVF index stored by cell (nprobe = nlist: equals exact search)."""
    from filtra.operators.ivf import ivf_search
    c, stored, cents = _ivf(spark, sf_dir)
    return ivf_search(stored, cents, group_queries(c), nprobe=IVF_NLIST_FIXTURE, k=TOP_K)


@register("batch_hybrid_rrf")
def batch_hybrid_rrf_q(spark, sf_dir):
    """R7 for many queries at once: every (kbId, site) group searched with its
    lowest-id chunk as both the dense and the sparse query, each restricted to
    its own group; arms fused by RRF per qid. Each query's filter values are part
    of the posting join, so a frequent token pairs a document only with the
    queries of its own group."""
    from filtra.operators.search import search_batch
    c = chunks_view(spark, sf_dir)
    qs = group_queries(c)
    dense = search_batch(c, qs, k=TOP_K, fields=())
    texts = c.select(F.col("id").alias("qid"), "content").join(qs.select("qid", "kbId", "site"), "qid")
    ix = text_index(spark, sf_dir)
    scores = ix.scores(ix.query_terms(texts, keep=("qid", "kbId", "site")), same=("kbId", "site"))
    sparse = topk(scores, TOP_K, keys=["qid"])
    return rrf([dense, sparse], k=TOP_K, keys=["qid"])


# further registered queries; they need the names above
from filtra.plans import sparse_maps, workload  # noqa: E402, F401
