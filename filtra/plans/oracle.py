"""DuckDB SQL equivalents of the registered queries (the correctness oracle).

The driver pre-registers the parquet tables as views; the chunk, posting and
log views of ``filtra.sources`` are re-stated here as CTEs.
"""

from __future__ import annotations

import json

ANCHOR = 7

CHUNKS = """chunks AS (
  SELECT e.vec_id AS id,
         'kb_' || lpad(e.label::VARCHAR, 2, '0') AS kbId,
         'doc_' || lpad((d.doc_id + 1)::VARCHAR, 8, '0') AS documentId,
         e.embedding AS embedding,
         d.text AS content,
         'S' || lpad(substr(d.source, 4)::VARCHAR, 3, '0') AS study,
         'SITE_' || upper(d.lang) AS site,
         'P' || lpad((d.n_chars % 30)::VARCHAR, 5, '0') AS patient,
         'V' || lpad((d.doc_id % 30)::VARCHAR, 2, '0') AS visit
  FROM embeddings e JOIN documents d ON e.vec_id = d.doc_id)"""

ANCHOR_CTE = f"anchor AS (SELECT * FROM chunks WHERE id = {ANCHOR})"

POSTINGS = """toks AS (
  SELECT id, list_filter(regexp_split_to_array(lower(content), '[^a-z0-9]+'), lambda t: t <> '') AS tk
  FROM chunks),
dls AS (SELECT id, len(tk) AS dl FROM toks),
bm25_stats AS (SELECT count(*) AS n, sum(dl)::DOUBLE / count(*) AS avgdl FROM dls),
tfs AS (SELECT id, token, count(*) AS tf
        FROM (SELECT id, unnest(tk) AS token FROM toks) GROUP BY id, token),
dfs AS (SELECT token, count(*) AS df FROM tfs GROUP BY token),
postings AS (
  SELECT tfs.id, tfs.token, tfs.tf,
         ln(1.0 + (s.n - dfs.df + 0.5) / (dfs.df + 0.5)) * tfs.tf * 2.2
           / (tfs.tf + 1.2 * (0.25 + 0.75 * d.dl / s.avgdl)) AS weight
  FROM tfs JOIN dfs USING (token) JOIN dls d USING (id) CROSS JOIN bm25_stats s)"""

OUT = "documentId, study, site, patient, visit"
OUT_C = "c.documentId, c.study, c.site, c.patient, c.visit"


def ip(a: str, b: str) -> str:
    return f"round(list_inner_product({a}::DOUBLE[], {b}::DOUBLE[]), 6)"


def ranked(src: str, score: str = "score", desc: bool = True, k: int = 10,
           part: str = "") -> str:
    d = "DESC" if desc else "ASC"
    p = f"PARTITION BY {part} " if part else ""
    return (f"SELECT *, row_number() OVER ({p}ORDER BY {score} {d}, id) AS rank FROM {src} "
            f"QUALIFY rank <= {k}")


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


ORACLE_SQL: dict[str, str] = {}

KB_SITE = "c.kbId = a.kbId AND c.site = a.site"

ORACLE_SQL["hybrid_rrf"] = with_(
    CHUNKS, ANCHOR_CTE, POSTINGS,
    f"dense AS (SELECT c.id, {ip('c.embedding', 'a.embedding')} AS score "
    f"FROM chunks c, anchor a WHERE {KB_SITE})",
    f"dense_r AS ({ranked('dense')})",
    "qt AS (SELECT token, weight AS qweight FROM postings WHERE id = 7)",
    f"sp AS (SELECT p.id, round(sum(p.weight * q.qweight), 6) AS score "
    f"FROM postings p JOIN qt q USING (token) "
    f"WHERE p.id IN (SELECT c.id FROM chunks c, anchor a WHERE {KB_SITE}) GROUP BY p.id)",
    f"sp_r AS ({ranked('sp')})",
    "fused AS (SELECT id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM "
    "(SELECT id, rank FROM dense_r UNION ALL SELECT id, rank FROM sp_r) GROUP BY id)",
    f"top AS ({ranked('fused')})",
) + f"SELECT top.rank, top.id, top.score, {OUT_C} FROM top JOIN chunks c USING (id)"


# ------------------------------------------------------------------ helpers

def l2(a: str, b: str) -> str:
    return f"round(list_distance({a}::DOUBLE[], {b}::DOUBLE[]), 6)"


def cos(a: str, b: str) -> str:
    na = f"list_inner_product({a}::DOUBLE[], {a}::DOUBLE[])"
    nb = f"list_inner_product({b}::DOUBLE[], {b}::DOUBLE[])"
    return (f"round(CASE WHEN {na} = 0 OR {nb} = 0 THEN 0.0 ELSE "
            f"list_inner_product({a}::DOUBLE[], {b}::DOUBLE[]) / (sqrt({na}) * sqrt({nb})) END, 6)")


SCORERS = {"IP": ip, "L2": l2, "COSINE": cos}


def dense_topk(where: str | None, metric: str = "IP", out: str = OUT, k: int = 10,
               extra: tuple = ()) -> str:
    score = SCORERS[metric]("c.embedding", "a.embedding")
    w = where or "TRUE"
    return with_(
        CHUNKS, ANCHOR_CTE, *extra,
        f"s AS (SELECT c.id, {score} AS score, c.* EXCLUDE (id) FROM chunks c, anchor a WHERE {w})",
        f"top AS ({ranked('s', desc=(metric != 'L2'), k=k)})",
    ) + f"SELECT rank, id, score{', ' + out if out else ''} FROM top"


Q3_IDS = ("q3_ids AS (SELECT documentId FROM (SELECT 'doc_' || lpad((doc_id + 1)::VARCHAR, 8, '0') "
          "AS documentId FROM documents) ORDER BY md5('44:' || documentId), documentId LIMIT 100)")

EQ = {f: f"c.{f} = a.{f}" for f in ("kbId", "study", "site", "patient", "visit")}
ALL5 = " AND ".join(EQ.values())

DENSE_ARM = (f"dense AS (SELECT c.id, {ip('c.embedding', 'a.embedding')} AS score "
             f"FROM chunks c, anchor a WHERE {KB_SITE})")
SPARSE_ARM = (
    "qt AS (SELECT token, weight AS qweight FROM postings WHERE id = 7)",
    "sp AS (SELECT p.id, round(sum(p.weight * q.qweight), 6) AS score "
    "FROM postings p JOIN qt q USING (token) "
    f"WHERE p.id IN (SELECT c.id FROM chunks c, anchor a WHERE {KB_SITE}) GROUP BY p.id)",
)
ARMS = (CHUNKS, ANCHOR_CTE, POSTINGS, DENSE_ARM, f"dense_r AS ({ranked('dense')})",
        *SPARSE_ARM, f"sp_r AS ({ranked('sp')})",
        "fused AS (SELECT id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM "
        "(SELECT id, rank FROM dense_r UNION ALL SELECT id, rank FROM sp_r) GROUP BY id)",
        f"rrf_top AS ({ranked('fused')})",
        "wsum AS (SELECT id, round(sum(s), 6) AS score FROM (SELECT id, score * 1.0 AS s FROM dense_r "
        "UNION ALL SELECT id, score * 1.0 AS s FROM sp_r) GROUP BY id)",
        f"w_top AS ({ranked('wsum')})")


def overlap_sql(left: str, right: str, label: str) -> str:
    return (f"SELECT '{label}' AS pair, shared, only_left, only_right, "
            f"round(CASE WHEN shared + only_left + only_right = 0 THEN 0.0 ELSE "
            f"shared / (shared + only_left + only_right) END, 6) AS jaccard FROM ("
            f"SELECT count(*) FILTER (WHERE l.id IS NOT NULL AND r.id IS NOT NULL) AS shared, "
            f"count(*) FILTER (WHERE r.id IS NULL) AS only_left, "
            f"count(*) FILTER (WHERE l.id IS NULL) AS only_right "
            f"FROM (SELECT DISTINCT id FROM {left}) l FULL JOIN (SELECT DISTINCT id FROM {right}) r "
            f"ON l.id = r.id)")


ORACLE_SQL.update({
    "scan_project": with_(CHUNKS) + "SELECT id, kbId, documentId FROM chunks",
    "vec_inner_product": with_(CHUNKS, ANCHOR_CTE)
    + f"SELECT c.id, {ip('c.embedding', 'a.embedding')} AS score FROM chunks c, anchor a",
    "vec_l2": with_(CHUNKS, ANCHOR_CTE)
    + f"SELECT c.id, {l2('c.embedding', 'a.embedding')} AS score FROM chunks c, anchor a",
    "vec_cosine": with_(CHUNKS, ANCHOR_CTE)
    + f"SELECT c.id, {cos('c.embedding', 'a.embedding')} AS score FROM chunks c, anchor a",
    "vec_normalize": with_(
        CHUNKS,
        "n AS (SELECT id, embedding, sqrt(list_inner_product(embedding::DOUBLE[], "
        "embedding::DOUBLE[])) AS nrm FROM chunks)",
        "u AS (SELECT id, nrm, list_transform(embedding, lambda x: (x::DOUBLE / "
        "(CASE WHEN nrm = 0 THEN 1.0 ELSE nrm END))::FLOAT) AS unit FROM n)")
    + "SELECT id, round(nrm, 6) AS norm_in, "
      "round(sqrt(list_inner_product(unit::DOUBLE[], unit::DOUBLE[])), 6) AS norm_out, "
      "round(list_sum(unit::DOUBLE[]), 6) AS sum_out, len(unit)::BIGINT AS dim FROM u",
    "sparse_inner_product": with_(
        CHUNKS, POSTINGS, "qt AS (SELECT token, weight AS qweight FROM postings WHERE id = 7)",
        "s AS (SELECT p.id, sum(p.weight * q.qweight) AS score FROM postings p "
        "JOIN qt q USING (token) GROUP BY p.id)")
    + "SELECT c.id, round(coalesce(s.score, 0.0), 6) AS score FROM chunks c LEFT JOIN s USING (id)",
    "filtered_topk": dense_topk(KB_SITE),
    "q1_single_eq": dense_topk(f"{EQ['kbId']} AND {EQ['study']}"),
    "q2_multi_and": dense_topk(ALL5),
    "q3_document_in": dense_topk(f"{EQ['kbId']} AND c.documentId IN (SELECT documentId FROM q3_ids)",
                                 extra=(Q3_IDS,)),
    "q7_kb_in": dense_topk("c.kbId IN ('kb_00', 'kb_05', 'kb_09')"),
    "q7_no_filter": dense_topk(None),
    "q7_one_kb": dense_topk("c.kbId = 'kb_00'"),
    "q5_scalar_only": with_(CHUNKS, ANCHOR_CTE)
    + f"SELECT c.id, c.kbId, c.documentId FROM chunks c, anchor a WHERE {ALL5} ORDER BY c.id LIMIT 100",
    "output_fields": dense_topk(KB_SITE, out="documentId, kbId, study, site, patient, visit, content"),
    "vec_l2_topk": dense_topk(KB_SITE, metric="L2"),
    "vec_cosine_topk": dense_topk(KB_SITE, metric="COSINE"),
    "batch_topk": with_(
        CHUNKS,
        "g AS (SELECT kbId, site, min(id) AS qid FROM chunks GROUP BY kbId, site)",
        "q AS (SELECT g.qid, g.kbId, g.site, c.embedding AS qv FROM g JOIN chunks c ON c.id = g.qid)",
        f"s AS (SELECT q.qid, c.id, {ip('c.embedding', 'q.qv')} AS score, {OUT_C} "
        "FROM chunks c JOIN q ON c.kbId = q.kbId AND c.site = q.site)",
        f"top AS ({ranked('s', part='qid')})")
    + f"SELECT qid, rank, id, score, {OUT} FROM top",
    "sparse_topk": with_(CHUNKS, ANCHOR_CTE, POSTINGS, *SPARSE_ARM, f"sp_r AS ({ranked('sp')})")
    + "SELECT rank, id, score FROM sp_r",
    "bm25_weights": with_(CHUNKS, POSTINGS)
    + "SELECT id, token, tf, round(weight, 6) AS weight FROM postings",
    "hybrid_weighted": with_(*ARMS) + "SELECT rank, id, score FROM w_top",
    "hybrid_weighted_minmax": with_(
        *ARMS,
        "mm AS (SELECT id, CASE WHEN max(score) OVER () = min(score) OVER () THEN 1.0 ELSE "
        "(score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) END AS s FROM dense_r "
        "UNION ALL SELECT id, CASE WHEN max(score) OVER () = min(score) OVER () THEN 1.0 ELSE "
        "(score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) END AS s FROM sp_r)",
        "mms AS (SELECT id, round(sum(s * 1.0), 6) AS score FROM mm GROUP BY id)",
        f"mm_top AS ({ranked('mms')})")
    + "SELECT rank, id, score FROM mm_top",
    "recall_at_k": with_(*ARMS)
    + "SELECT count(*) AS k, count(r.id) AS found, round(count(r.id) / count(*), 6) AS recall "
      "FROM dense_r d LEFT JOIN rrf_top r USING (id)",
    "ranker_overlap": with_(*ARMS)
    + overlap_sql("dense_r", "rrf_top", "dense_vs_rrf") + " UNION ALL "
    + overlap_sql("rrf_top", "w_top", "rrf_vs_weighted"),
})


# ------------------------------------------------------------- logs

REQUEST_LOG = """request_log AS (
  SELECT event_id AS request_id, ts, event_type AS query,
         CASE WHEN user_id % 2 = 0 THEN 'plain' ELSE 'partitioned' END AS plan,
         CASE user_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 4 WHEN 2 THEN 16 ELSE 32 END AS concurrency,
         value AS latency_ms
  FROM events)"""

EVENT_LOG = """event_log AS (
  SELECT phase,
         row_number() OVER (PARTITION BY phase ORDER BY ts, event_id) AS iteration,
         CASE WHEN event_type = 'error' THEN 'create_failed' ELSE 'sample' END AS event,
         value AS create_ms,
         json_extract_string(props, '$.k')::DOUBLE AS list_ms,
         CASE WHEN event_type = 'error' THEN 'code=' || user_id::VARCHAR ELSE '' END AS error,
         (epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY phase))) / 1e6 AS elapsed_s,
         ts, event_id
  FROM (SELECT *, (1 + floor((day(ts) - 1) / 8))::INTEGER AS phase FROM events))"""

PHASE_TOTALS = ("phase_totals AS (SELECT phase, count(*) FILTER (WHERE event <> 'create_failed') AS n, "
                "max(elapsed_s) AS wall_s FROM event_log GROUP BY phase)")

CREATED = (EVENT_LOG, PHASE_TOTALS,
           "starts AS (SELECT phase, coalesce(sum(n) OVER (ORDER BY phase ROWS BETWEEN UNBOUNDED "
           "PRECEDING AND 1 PRECEDING), 0) AS start FROM phase_totals)",
           "created AS (SELECT e.*, s.start + sum(CASE WHEN event <> 'create_failed' THEN 1 ELSE 0 END) "
           "OVER (PARTITION BY e.phase ORDER BY iteration ROWS UNBOUNDED PRECEDING) AS created_so_far "
           "FROM event_log e JOIN starts s USING (phase))")


def q(col: str, p: float) -> str:
    return f"quantile_cont({col}, {p})"


ORACLE_SQL.update({
    "latency_summary": with_(
        REQUEST_LOG,
        "labels AS (SELECT DISTINCT query FROM request_log)",
        f"st AS (SELECT query, count(latency_ms) AS n, {q('latency_ms', 0.5)} AS p50_ms, "
        f"{q('latency_ms', 0.95)} AS p95_ms, {q('latency_ms', 0.99)} AS p99_ms, "
        "avg(latency_ms) AS mean_ms, min(latency_ms) AS min_ms, max(latency_ms) AS max_ms "
        "FROM request_log WHERE concurrency = 1 GROUP BY query)")
    + "SELECT l.query, coalesce(n, 0)::BIGINT AS n, "
    + ", ".join(f"round(coalesce({c}, 0.0), 6) AS {c}" for c in
                ("p50_ms", "p95_ms", "p99_ms", "mean_ms", "min_ms", "max_ms"))
    + " FROM labels l LEFT JOIN st USING (query)",
    "throughput": with_(REQUEST_LOG)
    + "SELECT concurrency, count(*) AS requests, "
      "round(greatest((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 1.0), 6) AS window_s, "
      "round(count(*) / greatest((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 1.0), 2) AS qps "
      "FROM request_log GROUP BY concurrency",
    "phase_summary": with_(
        EVENT_LOG, PHASE_TOTALS,
        "per AS (SELECT phase, coalesce(sum(n) OVER (ORDER BY phase ROWS BETWEEN UNBOUNDED PRECEDING "
        "AND 1 PRECEDING), 0) AS start, n, wall_s FROM phase_totals)",
        "r AS (SELECT phase, min(start) AS start, sum(n) AS n, sum(wall_s) AS wall_s FROM per "
        "GROUP BY ROLLUP (phase))")
    + "SELECT phase, start::BIGINT AS start, n::BIGINT AS n, round(wall_s, 1) AS wall_s, "
      "round(CASE WHEN wall_s > 0 THEN n / wall_s END, 1) AS rate FROM r",
    "growth_rate": with_(*CREATED)
    + "SELECT phase, round(regr_slope(create_ms, created_so_far), 6) AS create_ms_per_item, "
      "round(regr_slope(list_ms, created_so_far), 6) AS list_ms_per_item, "
      "max(created_so_far)::BIGINT AS created, round(max(created_so_far) / 65536.0, 6) AS share_of_limit "
      "FROM created WHERE event <> 'create_failed' GROUP BY phase",
    "latency_trend": with_(
        *CREATED,
        "b AS (SELECT (floor(created_so_far / 1000) * 1000)::BIGINT AS bucket, create_ms, list_ms "
        "FROM created WHERE event <> 'create_failed')",
        f"p AS (SELECT bucket, {q('create_ms', 0.5)} AS create_p50, {q('create_ms', 0.99)} AS create_p99, "
        f"{q('list_ms', 0.5)} AS list_p50, {q('list_ms', 0.99)} AS list_p99 FROM b GROUP BY bucket)")
    + "SELECT bucket, round(create_p50, 6) AS create_p50, round(create_p99, 6) AS create_p99, "
      "round(list_p50, 6) AS list_p50, round(list_p99, 6) AS list_p99, "
      "round(create_p50 / first_value(create_p50) OVER (ORDER BY bucket), 6) AS create_p50_ratio, "
      "round(list_p50 / first_value(list_p50) OVER (ORDER BY bucket), 6) AS list_p50_ratio FROM p",
    "plan_compare": with_(
        REQUEST_LOG,
        f"p AS (SELECT query, plan, {q('latency_ms', 0.5)} AS p50, {q('latency_ms', 0.95)} AS p95, "
        f"{q('latency_ms', 0.99)} AS p99 FROM request_log GROUP BY query, plan)")
    + "SELECT query, "
    + ", ".join(f"round(max({m}) FILTER (WHERE plan = '{pl}'), 6) AS {pl}_{m}"
                for pl in ("plain", "partitioned") for m in ("p50", "p95", "p99"))
    + ", round(max(p50) FILTER (WHERE plan = 'plain') / max(p50) FILTER (WHERE plan = 'partitioned'), 6) "
      "AS speedup_p50 FROM p GROUP BY query",
    "dataset_profile": with_(CHUNKS)
    + "SELECT count(*) AS rows, count(DISTINCT documentId) AS documents, "
    + ", ".join(f"string_agg(DISTINCT {f}, ',' ORDER BY {f}) AS {f}_values"
                for f in ("kbId", "study", "site", "patient", "visit"))
    + ", " + ", ".join(f"count(DISTINCT {f}) AS {f}_n" for f in ("kbId", "study", "site", "patient", "visit"))
    + " FROM chunks",
    "skew_profile": with_(
        CHUNKS,
        "c AS (SELECT kbId, count(*) AS rows FROM chunks GROUP BY kbId)",
        "r AS (SELECT kbId, rows, row_number() OVER (ORDER BY rows DESC, kbId) AS rank, "
        "sum(rows) OVER () AS tot, count(*) OVER () AS k FROM c)",
        "w AS (SELECT *, 1.0 / pow(rank::DOUBLE, 1.0) AS wt FROM r)",
        "h AS (SELECT *, sum(wt) OVER () AS hs FROM w)")
    + "SELECT kbId, rows, round(rows / tot, 6) AS share, rank, round(wt / hs, 6) AS expected_share, "
      "CASE WHEN rank = 1 THEN 'hot' WHEN rank = k THEN 'cold' WHEN rank = floor(k / 2) + 1 "
      "THEN 'middle' ELSE 'other' END AS tier FROM h",
    "running_created": with_(*CREATED)
    + "SELECT phase, iteration, event, created_so_far::BIGINT AS created_so_far FROM created",
    "systematic_sample": with_(*CREATED)
    + "SELECT phase, iteration, event, created_so_far::BIGINT AS created_so_far, create_ms, list_ms "
      "FROM created QUALIFY iteration % 50 = 0 OR iteration = max(iteration) OVER (PARTITION BY phase)",
    "first_failure": with_(*CREATED)
    + "SELECT p.phase, f.fail_iteration, f.error, f.created_before FROM "
      "(SELECT DISTINCT phase FROM created) p LEFT JOIN "
      "(SELECT phase, min(iteration) AS fail_iteration, arg_min(error, iteration) AS error, "
      "arg_min(created_so_far, iteration)::BIGINT AS created_before FROM created "
      "WHERE event = 'create_failed' GROUP BY phase) f USING (phase)",
})


# -------------------------------------------------------- generator

FIELD_FMT = {"kbId": ("kb_", 2, 10, "kb:"), "study": ("S", 3, 30, "study:"),
             "site": ("SITE_", 3, 30, "site:"), "patient": ("P", 5, 30, "patient:"),
             "visit": ("V", 2, 30, "visit:")}


def u_sql(salt: str, key: str) -> str:
    return f"(('0x' || substr(md5('{salt}' || {key}::VARCHAR), 1, 8))::BIGINT / 4294967296.0)"


def zipf_pools() -> list[str]:
    ctes = []
    for f, (prefix, digits, card, _salt) in FIELD_FMT.items():
        ctes.append(
            f"z_{f} AS (SELECT pos, value, coalesce(lag(hi) OVER (ORDER BY pos), 0.0) AS lo, "
            f"CASE WHEN pos = {card - 1} THEN 2.0 ELSE hi END AS hi FROM ("
            f"SELECT pos, '{prefix}' || lpad(pos::VARCHAR, {digits}, '0') AS value, "
            f"sum(w / tot) OVER (ORDER BY pos ROWS UNBOUNDED PRECEDING) AS hi FROM ("
            f"SELECT range AS pos, 1.0 / pow(range + 1, 1.0) AS w, "
            f"sum(1.0 / pow(range + 1, 1.0)) OVER () AS tot FROM range({card}))))")
    return ctes


def zipf_select(key: str = "d.doc_id", src: str = "documents d") -> str:
    cols = ", ".join(f"z_{f}.value AS {f}" for f in FIELD_FMT)
    joins = " ".join(
        f"JOIN z_{f} ON {u_sql(salt, key)} >= z_{f}.lo AND {u_sql(salt, key)} < z_{f}.hi"
        for f, (_p, _d, _c, salt) in FIELD_FMT.items())
    return f"SELECT d.doc_id, {cols} FROM {src} {joins}"


GEN = (*zipf_pools(),
       f"attrs AS ({zipf_select()})",
       "gd AS (SELECT a.*, (20 + (('0x' || substr(md5('n:' || doc_id::VARCHAR), 1, 8))::BIGINT % 481))"
       "::INTEGER AS n FROM attrs a)",
       "go AS (SELECT *, coalesce(sum(n) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND "
       "1 PRECEDING), 0) AS off FROM gd)",
       "gen AS (SELECT (off + chunk_no - 1)::BIGINT AS id, 'doc_' || lpad((doc_id + 1)::VARCHAR, 8, '0') "
       "AS documentId, n, chunk_no, kbId, study, site, patient, visit FROM ("
       "SELECT *, unnest(generate_series(1, n))::INTEGER AS chunk_no FROM go))")

ORACLE_SQL.update({
    "zipf_assign": with_(*zipf_pools()) + zipf_select(),
    "chunk_expand": with_(*GEN) + "SELECT * FROM gen",
    "content_template": with_(CHUNKS)
    + "SELECT id, rpad('', 256, 'a placeholder passage of a document chunk; ') "
      "AS content FROM chunks",
    "chunks_per_document": with_(*GEN, "per AS (SELECT documentId, count(*) AS n FROM gen GROUP BY documentId)")
    + "SELECT count(*) AS documents, sum(n)::BIGINT AS rows, min(n) AS min_chunks, max(n) AS max_chunks, "
      "round(avg(n), 6) AS mean_chunks, floor(sum(n) / 260)::BIGINT AS estimated_documents FROM per",
    "skew_profile_generated": with_(
        *GEN,
        "c AS (SELECT kbId, count(*) AS rows FROM gen GROUP BY kbId)",
        "r AS (SELECT kbId, rows, row_number() OVER (ORDER BY rows DESC, kbId) AS rank, "
        "sum(rows) OVER () AS tot, count(*) OVER () AS k FROM c)",
        "w AS (SELECT *, 1.0 / pow(rank::DOUBLE, 1.0) AS wt FROM r)",
        "h AS (SELECT *, sum(wt) OVER () AS hs FROM w)")
    + "SELECT kbId, rows, round(rows / tot, 6) AS share, rank, round(wt / hs, 6) AS expected_share, "
      "CASE WHEN rank = 1 THEN 'hot' WHEN rank = k THEN 'cold' WHEN rank = floor(k / 2) + 1 "
      "THEN 'middle' ELSE 'other' END AS tier FROM h",
    "chunk_hits_by_document": with_(*GEN, Q3_IDS)
    + "SELECT documentId, count(*) AS chunks FROM gen WHERE documentId IN (SELECT documentId FROM q3_ids) "
      "GROUP BY documentId",
})

VALIDATE_CHECKS = (
    [("id IS NULL", "id_null"), ("kbId IS NULL", "kbId_null"),
     ("documentId IS NULL", "documentId_null"), ("embedding IS NULL", "embedding_null")]
    + [(f"length({c}) > {n}", f"{c}_too_long") for c, n in
       (("kbId", 16), ("documentId", 64), ("content", 2048), ("study", 32), ("site", 32),
        ("patient", 64), ("visit", 32))]
    + [("len(embedding) <> 64", "embedding_dim"),
       ("id IN (SELECT id FROM chunks GROUP BY id HAVING count(*) > 1)", "duplicate_id")])

ORACLE_SQL.update({
    "partitioned_layout": with_(CHUNKS)
    + "SELECT kbId, count(*) AS rows_by_kb, count(*) AS rows_by_bucket FROM chunks GROUP BY kbId",
    "partitioned_topk": ORACLE_SQL["filtered_topk"],
    "partitioned_topk_bucket": ORACLE_SQL["filtered_topk"],
    "schema_validate": with_(
        CHUNKS,
        "r AS (SELECT id, concat_ws(';', "
        + ", ".join(f"CASE WHEN {cond} THEN '{name}' END" for cond, name in VALIDATE_CHECKS)
        + ") AS reasons FROM chunks)")
    + "SELECT id, reasons FROM r WHERE reasons <> ''",
    "sink_manifest": ORACLE_SQL["dataset_profile"].replace(" FROM chunks", ", '" + json.dumps({
        "alpha": 1.0, "chunks_max": 500, "chunks_min": 20, "dim": 64,
        "pools": {"kbId": 10, "patient": 30, "site": 30, "study": 30, "visit": 30}, "seed": 42,
        "sparse_nnz": 64, "sparse_vocab": 30000, "top_k": 10}, sort_keys=True) + "' AS settings FROM chunks"),
    "sink_results_csv": ORACLE_SQL["latency_summary"],
    "sink_modes": with_(CHUNKS) + "SELECT id, kbId FROM chunks",
})


# ---------------------------------------------------- predicates as data

DRAWN = ("drawn AS (SELECT row_number() OVER (ORDER BY md5('44:' || id::VARCHAR), id) AS qid, "
         "id AS source_id, kbId, study, site, patient, visit FROM chunks "
         "ORDER BY md5('44:' || id::VARCHAR), id LIMIT 20)")

TIERS = ("kc AS (SELECT kbId, count(*) AS rows FROM chunks GROUP BY kbId)",
         "kr AS (SELECT kbId, rows, row_number() OVER (ORDER BY rows DESC, kbId) - 1 AS pos, "
         "count(*) OVER () AS n FROM kc)",
         "tiers AS (SELECT kbId, pos, CASE WHEN pos = 0 THEN 'hot' WHEN pos = floor(n / 2) THEN 'middle' "
         "WHEN pos = n - 1 THEN 'cold' END AS tier FROM kr WHERE pos = 0 OR pos = floor(n / 2) OR pos = n - 1)",
         "reps AS (SELECT kbId, min(id) AS rep_id FROM chunks GROUP BY kbId)",
         "tp AS (SELECT t.pos AS qid, t.tier, c.kbId, c.study, c.site, c.patient, c.visit FROM tiers t "
         "JOIN reps r USING (kbId) JOIN chunks c ON c.id = r.rep_id)")

GSETS = ("tot AS (SELECT count(*)::DOUBLE AS n FROM chunks)",
         "cand AS (SELECT kbId, study, site, patient, visit, count(*) AS hits, "
         "1 + (study IS NOT NULL)::INT + (site IS NOT NULL)::INT + (patient IS NOT NULL)::INT "
         "+ (visit IS NOT NULL)::INT AS n_fields FROM chunks GROUP BY GROUPING SETS ((kbId), "
         "(kbId, study), (kbId, site), (kbId, patient), (kbId, visit), "
         "(kbId, study, site, patient, visit)))",
         "rates AS (SELECT cand.*, hits * 100.0::DOUBLE / tot.n AS rate_pct FROM cand, tot)",
         "targets AS (SELECT unnest([0.01, 0.1, 1.0, 10.0, 30.0]::DOUBLE[]) AS target_pct)",
         "best AS (SELECT * FROM rates, targets QUALIFY row_number() OVER (PARTITION BY target_pct "
         "ORDER BY abs(rate_pct - target_pct), n_fields, kbId NULLS FIRST, study NULLS FIRST, "
         "site NULLS FIRST, patient NULLS FIRST, visit NULLS FIRST) = 1)",
         "bq AS (SELECT row_number() OVER (ORDER BY target_pct) AS qid, * FROM best)")

NULL_EQ = " AND ".join(f"(p.{f} IS NULL OR c.{f} = p.{f})" for f in ("study", "site", "patient", "visit"))

ORACLE_SQL.update({
    "predicate_draw": with_(CHUNKS) + DRAWN[len("drawn AS ("):-1],
    "predicate_table": with_(CHUNKS, DRAWN)
    + "SELECT p.qid, c.id FROM chunks c JOIN drawn p ON c.kbId = p.kbId AND c.site = p.site",
    "hit_count": with_(CHUNKS, DRAWN)
    + "SELECT p.qid, count(c.id) AS hits, round(count(c.id) / (SELECT count(*) FROM chunks)::DOUBLE, 6) "
      "AS share FROM drawn p LEFT JOIN chunks c ON c.kbId = p.kbId AND c.site = p.site GROUP BY p.qid",
    "predicate_batch_topk": with_(
        CHUNKS, DRAWN,
        "q AS (SELECT p.qid, p.kbId, p.site, c.embedding AS qv FROM drawn p JOIN chunks c "
        "ON c.id = p.source_id)",
        f"s AS (SELECT q.qid, c.id, {ip('c.embedding', 'q.qv')} AS score, {OUT_C} "
        "FROM chunks c JOIN q ON c.kbId = q.kbId AND c.site = q.site)",
        f"top AS ({ranked('s', part='qid')})")
    + f"SELECT qid, rank, id, score, {OUT} FROM top",
    "q7_hot_mid_cold": with_(
        CHUNKS, ANCHOR_CTE, *TIERS,
        f"s AS (SELECT p.qid, p.tier, c.id, {ip('c.embedding', 'a.embedding')} AS score, {OUT_C} "
        f"FROM chunks c JOIN tp p ON c.kbId = p.kbId AND {NULL_EQ} CROSS JOIN anchor a)",
        f"top AS ({ranked('s', part='qid')})")
    + f"SELECT qid, rank, id, score, {OUT}, tier FROM top",
    "q4_hit_rate_scan": with_(
        CHUNKS, ANCHOR_CTE, *GSETS,
        f"s AS (SELECT p.qid, p.target_pct, round(p.rate_pct, 6) AS rate_pct, p.hits, c.id, "
        f"{ip('c.embedding', 'a.embedding')} AS score FROM chunks c JOIN bq p ON c.kbId = p.kbId "
        f"AND {NULL_EQ} CROSS JOIN anchor a)",
        f"top AS ({ranked('s', part='qid')})")
    + "SELECT rank, id, score, target_pct, rate_pct, hits FROM top",
})

ORACLE_SQL["ivf_search"] = ORACLE_SQL["batch_topk"]

ORACLE_SQL.update({
    "stream_ingest": with_(CHUNKS)
    + "SELECT id, kbId, documentId FROM chunks WHERE NOT (" + " OR ".join(
        f"coalesce({cond}, false)" for cond, _ in VALIDATE_CHECKS[:-1]) + ")",
    "stream_latency_qps": with_(
        REQUEST_LOG,
        "w AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS ws, query, latency_ms FROM request_log)",
        "agg AS (SELECT ws, query, count(*) AS requests, quantile_cont(latency_ms, 0.5) AS p50, "
        "quantile_cont(latency_ms, 0.99) AS p99 FROM w GROUP BY ws, query)")
    + "SELECT epoch(ws)::BIGINT AS window_start, "
      "epoch(ws + INTERVAL 1 DAY)::BIGINT AS window_end, query, requests, "
      "round(requests / 86400.0, 6) AS qps, round(p50, 6) AS p50_ms, round(p99, 6) AS p99_ms FROM agg "
      "WHERE ws + INTERVAL 1 DAY <= (SELECT max(ts) FROM request_log) - INTERVAL 1 HOUR",
    "stream_search": ORACLE_SQL["batch_topk"],
})

ORACLE_SQL["q7_hot_mid_cold_pool"] = with_(
    CHUNKS, ANCHOR_CTE,
    "tiers AS (SELECT * FROM (VALUES ('hot', 0, 'kb_00'), ('middle', 5, 'kb_05'), ('cold', 9, 'kb_09')) "
    "t(tier, pos, kbId))",
    "reps AS (SELECT kbId, min(id) AS rep_id FROM chunks GROUP BY kbId)",
    "tp AS (SELECT t.pos::BIGINT AS qid, t.tier, c.kbId, c.study, c.site, c.patient, c.visit FROM tiers t "
    "JOIN reps r USING (kbId) JOIN chunks c ON c.id = r.rep_id)",
    f"s AS (SELECT p.qid, p.tier, c.id, {ip('c.embedding', 'a.embedding')} AS score, {OUT_C} "
    f"FROM chunks c JOIN tp p ON c.kbId = p.kbId AND {NULL_EQ} CROSS JOIN anchor a)",
    f"top AS ({ranked('s', part='qid')})") + f"SELECT qid, rank, id, score, {OUT}, tier FROM top"

ORACLE_SQL["sparse_topk_stored"] = ORACLE_SQL["sparse_topk"]
ORACLE_SQL["ivf_search_stored"] = ORACLE_SQL["batch_topk"]

ORACLE_SQL["batch_hybrid_rrf"] = with_(
    CHUNKS, POSTINGS,
    "g AS (SELECT kbId, site, min(id) AS qid FROM chunks GROUP BY kbId, site)",
    "q AS (SELECT g.qid, g.kbId, g.site, c.embedding AS qv FROM g JOIN chunks c ON c.id = g.qid)",
    f"dense AS (SELECT q.qid, c.id, {ip('c.embedding', 'q.qv')} AS score "
    "FROM chunks c JOIN q ON c.kbId = q.kbId AND c.site = q.site)",
    f"dense_r AS ({ranked('dense', part='qid')})",
    "qt AS (SELECT q.qid, p.token, p.weight AS qweight FROM postings p JOIN q ON p.id = q.qid)",
    "sp AS (SELECT qt.qid, p.id, round(sum(p.weight * qt.qweight), 6) AS score FROM postings p "
    "JOIN qt USING (token) JOIN chunks c ON c.id = p.id JOIN q ON q.qid = qt.qid "
    "AND c.kbId = q.kbId AND c.site = q.site GROUP BY qt.qid, p.id)",
    f"sp_r AS ({ranked('sp', part='qid')})",
    "fused AS (SELECT qid, id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM "
    "(SELECT qid, id, rank FROM dense_r UNION ALL SELECT qid, id, rank FROM sp_r) GROUP BY qid, id)",
    f"top AS ({ranked('fused', part='qid')})") + "SELECT qid, rank, id, score FROM top"

# queries on texts: every document, with or without an embedding
TEXTS = CHUNKS.replace("SELECT e.vec_id AS id", "SELECT d.doc_id AS id").replace(
    "FROM embeddings e JOIN documents d ON", "FROM documents d LEFT JOIN embeddings e ON")

for _name in ("sparse_topk", "sparse_topk_stored", "bm25_weights", "sparse_inner_product", "content_template",
              "schema_validate", "hybrid_rrf", "hybrid_weighted", "hybrid_weighted_minmax", "batch_hybrid_rrf",
              "recall_at_k", "ranker_overlap"):
    ORACLE_SQL[_name] = ORACLE_SQL[_name].replace(CHUNKS, TEXTS)


# ------------------------------------------------------ sparse maps

def _primes_above(n: int, count: int) -> list[int]:
    out, c = [], n + 1
    while len(out) < count:
        if all(c % p for p in range(2, int(c ** 0.5) + 1)):
            out.append(c)
        c += 1
    return out


def sparse_map(name: str, src: str, key: str, seed: int, nnz: int, keep: str = "", vocab: int = 30000) -> str:
    """CTE: one row per (key, token) of the generated map: token INTEGER, w FLOAT."""
    steps = ", ".join(str(x) for x in _primes_above(vocab, 16))
    start = f"md5('sa:{seed}:' || {key}::VARCHAR)"
    digest = f"md5('sw' || (j // 4)::VARCHAR || ':{seed}:' || {key}::VARCHAR)"
    return (f"{name} AS (SELECT {key} AS key{keep}, "
            f"((('0x' || substr({start}, 1, 8))::BIGINT % {vocab}) + j * ([{steps}])"
            f"[1 + ('0x' || substr({start}, 9, 8))::BIGINT % 16])::BIGINT % {vocab} AS token, "
            f"((('0x' || substr({digest}, (1 + 8 * (j % 4))::INT, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"
            f"::FLOAT AS w FROM {src}, (SELECT unnest(range({nnz})) AS j))")


MAPS = (sparse_map("rmap", "texts", "id", 42, 64, ", kbId, site"),
        sparse_map("qmap", "chunks", "id", 43, 32, ", kbId, site"))
TEXTS_CTE = TEXTS.replace("chunks AS (", "texts AS (", 1)


def map_scores(on: str) -> str:
    return ("s AS (SELECT q.key AS qid, r.key AS id, round(sum(q.w::DOUBLE * r.w::DOUBLE), 6) AS score "
            f"FROM qmap q JOIN rmap r ON r.token = q.token{on} GROUP BY q.key, r.key)")


ORACLE_SQL.update({
    "sparse_map_topk": with_(CHUNKS, TEXTS_CTE, *MAPS, map_scores(""), f"top AS ({ranked('s', part='qid')})")
    + "SELECT qid, rank, id, score FROM top",
    "sparse_map_filtered_topk": with_(
        CHUNKS, TEXTS_CTE, *MAPS, map_scores(" AND r.kbId = q.kbId AND r.site = q.site"),
        f"top AS ({ranked('s', part='qid')})") + "SELECT qid, rank, id, score FROM top",
    "hybrid_sparse_map": with_(
        CHUNKS, TEXTS_CTE, *MAPS, map_scores(" AND r.kbId = q.kbId"), f"sp AS ({ranked('s', part='qid')})",
        f"d AS (SELECT q.id AS qid, c.id, {ip('c.embedding', 'q.embedding')} AS score FROM chunks c "
        "JOIN chunks q ON c.kbId = q.kbId)",
        f"dr AS ({ranked('d', part='qid')})",
        "fused AS (SELECT qid, id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM "
        "(SELECT qid, id, rank FROM dr UNION ALL SELECT qid, id, rank FROM sp) GROUP BY qid, id)",
        f"top AS ({ranked('fused', part='qid')})")
    + f"SELECT t.qid, t.rank, t.id, t.score, {OUT_C} FROM top t JOIN chunks c ON c.id = t.id",
})

# ------------------------------------------------------ drawn workload (R2)

ORACLE_SQL["ivf_search_bounded"] = ORACLE_SQL["batch_topk"]
ORACLE_SQL["workload_topk"] = with_(
    CHUNKS,
    "num AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS at, count(*) OVER () AS n FROM chunks)",
    "q AS (SELECT w.qid, v.embedding AS qv, CASE WHEN w.qid % 51 <> 0 THEN p.kbId END AS kbId, "
    "CASE WHEN w.qid % 2 = 1 THEN p.study END AS study, CASE WHEN w.qid % 3 = 1 THEN p.site END AS site, "
    "CASE WHEN w.qid % 7 = 3 THEN p.patient END AS patient, CASE WHEN w.qid % 11 = 5 THEN p.visit END AS visit "
    "FROM (SELECT unnest(range(10000)) AS qid) w JOIN num v ON v.at = w.qid * 7919 % v.n "
    "JOIN num p ON p.at = w.qid * 104729 % p.n)",
    f"s AS (SELECT q.qid, c.id, {ip('c.embedding', 'q.qv')} AS score, {OUT_C} FROM chunks c JOIN q "
    "ON (q.kbId IS NULL OR c.kbId = q.kbId) AND (q.study IS NULL OR c.study = q.study) "
    "AND (q.site IS NULL OR c.site = q.site) AND (q.patient IS NULL OR c.patient = q.patient) "
    "AND (q.visit IS NULL OR c.visit = q.visit))",
    f"top AS ({ranked('s', part='qid')})") + f"SELECT qid, rank, id, score, {OUT} FROM top"

# ------------------------------------------- what any valid result must satisfy

GROUPS = "g AS (SELECT kbId, site, min(id) AS qid, count(*) AS n FROM chunks GROUP BY kbId, site)"

ORACLE_SQL.update({
    # vectors drawn by Spark's own hash: length and norm
    "dense_vectors": "SELECT doc_id, 8::BIGINT AS dim, 1.0::DOUBLE AS norm FROM documents",
    "sparse_vectors": with_(sparse_map("m", "documents", "doc_id", 42, 64))
    + "SELECT key AS doc_id, token, round(w::DOUBLE, 6) AS weight FROM m",
    "query_set": with_(sparse_map("m", "embeddings", "vec_id", 43, 32))
    + "SELECT key AS qid, 64::BIGINT AS dim, 1.0::DOUBLE AS norm, token, round(w::DOUBLE, 6) AS weight FROM m",
    # every chunk is in the cell of its nearest centre
    "ivf_build": with_(CHUNKS) + "SELECT id, true AS known_cell, true AS nearest FROM chunks",
    # a probe of some cells: own group only, exact scores, ranks without gaps, the query's own row among the hits
    "ivf_search_nprobe4": with_(CHUNKS, GROUPS)
    + "SELECT qid, true AS in_group, true AS exact, true AS ranked, true AS own FROM g",
    "ivf_search_widen": with_(CHUNKS, GROUPS)
    + "SELECT qid, least(n, 10)::BIGINT AS hits, true AS in_group, true AS exact, true AS ranked FROM g",
    "ivf_recall": with_(CHUNKS, GROUPS)
    + "SELECT qid, least(n, 10)::BIGINT AS k, true AS some, true AS share FROM g UNION ALL "
      "SELECT -1, sum(least(n, 10))::BIGINT, true, true FROM g",
    "generated_batch_topk": with_(*GEN)
    + "SELECT min(id) AS qid, kbId, least(count(*), 10)::BIGINT AS hits, min(id) AS best_id, "
      "1.0::DOUBLE AS best_score, true AS ranked FROM gen GROUP BY kbId",
})

# ------------------------------------------------ the log of a study that stops at failures

STOPPED = EVENT_LOG.replace("event_log AS (", "whole_log AS (", 1) + """,
event_log AS (SELECT * FROM whole_log QUALIFY iteration <= coalesce(
  min(CASE WHEN event = 'create_failed' THEN iteration END) OVER (PARTITION BY phase), iteration))"""

for _name, _from in (("study_phases", "phase_summary"), ("study_created", "running_created"),
                     ("study_growth", "growth_rate"), ("study_trend", "latency_trend")):
    ORACLE_SQL[_name] = ORACLE_SQL[_from].replace(EVENT_LOG, STOPPED)
ORACLE_SQL["study_trend"] = ORACLE_SQL["study_trend"].replace(
    "floor(created_so_far / 1000) * 1000", "floor(created_so_far / 10) * 10")

CHECKED = ("r AS (SELECT id, kbId, documentId, concat_ws(';', "
           + ", ".join(f"CASE WHEN {cond} THEN '{name}' END" for cond, name in VALIDATE_CHECKS[:-1])
           + ") AS reasons FROM chunks)")

ORACLE_SQL.update({
    "stream_ingest": with_(CHUNKS, CHECKED)
    + "SELECT id, kbId, documentId, reasons FROM r UNION ALL SELECT id, kbId, documentId, "
      "CASE WHEN reasons = '' THEN 'duplicate_id' ELSE reasons END FROM r WHERE id % 10 = 0",
    "ingest_rate": with_(CHUNKS, CHECKED)
    + "SELECT (count(*) + count(*) FILTER (WHERE id % 10 = 0))::BIGINT AS rows_in, "
      "(count(*) + count(*) FILTER (WHERE id % 10 = 0))::BIGINT AS total_in, "
      "count(*) FILTER (WHERE reasons = '')::BIGINT AS total_kept, true AS rated FROM r",
})

ORACLE_SQL["q3_long_list"] = dense_topk(
    f"{EQ['kbId']} AND substr(md5('44:' || c.documentId), 1, 1) < '8'")
ORACLE_SQL["q6_hybrid_multi_and"] = ORACLE_SQL["hybrid_rrf"].replace(KB_SITE, ALL5)
