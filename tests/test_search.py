import numpy as np
import pytest
from pyspark.sql import functions as F

from filtra.operators.search import search, search_batch


def brute(rows, q, k, keep=lambda r: True, metric="IP"):
    out = []
    qv = np.array(q, dtype=np.float64)
    for r in rows:
        if not keep(r):
            continue
        v = np.array(r["embedding"], dtype=np.float64)
        if metric == "IP":
            s = float(v @ qv)
        elif metric == "L2":
            s = float(np.linalg.norm(v - qv))
        else:
            s = float(v @ qv / (np.linalg.norm(v) * np.linalg.norm(qv)))
        out.append((round(s, 6), r["id"]))
    rev = metric != "L2"
    out.sort(key=lambda t: ((-t[0]) if rev else t[0], t[1]))
    return [i for _, i in out[:k]]


@pytest.mark.parametrize("metric", ["IP", "L2", "COSINE"])
def test_r1_matches_brute_force(chunks, chunk_rows, metric):
    q = chunk_rows[3]["embedding"]
    kb = chunk_rows[3]["kbId"]
    got = search(chunks, q, F.col("kbId") == kb, k=10, metric=metric, fields=()).orderBy("rank")
    ids = [r["id"] for r in got.collect()]
    assert ids == brute(chunk_rows, q, 10, lambda r: r["kbId"] == kb, metric)


@pytest.mark.parametrize("metric", ["IP", "L2", "COSINE"])
def test_kernel_equals_expression(spark, chunks, chunk_rows, metric):
    q = chunk_rows[5]["embedding"]
    kb, site = chunk_rows[5]["kbId"], chunk_rows[5]["site"]
    r1 = search(chunks, q, (F.col("kbId") == kb) & (F.col("site") == site), k=7, metric=metric,
                fields=())
    qs = spark.createDataFrame([(1, q, kb, site)], "qid long, q_dense array<float>, kbId string, site string")
    r2 = search_batch(chunks, qs, k=7, metric=metric, fields=())
    a = [(r["rank"], r["id"], r["score"]) for r in r1.orderBy("rank").collect()]
    b = [(r["rank"], r["id"], r["score"]) for r in r2.orderBy("rank").collect()]
    assert a == b


def test_batch_wildcards_and_no_hits(spark, chunks, chunk_rows):
    q = chunk_rows[0]["embedding"]
    qs = spark.createDataFrame(
        [(1, q, None, None), (2, q, "kb_none", None), (3, q, chunk_rows[0]["kbId"], None)],
        "qid long, q_dense array<float>, kbId string, site string")
    res = search_batch(chunks, qs, k=5, fields=())
    by = {}
    for r in res.collect():
        by.setdefault(r["qid"], []).append((r["rank"], r["id"]))
    assert [i for _, i in sorted(by[1])] == brute(chunk_rows, q, 5)
    assert 2 not in by  # a predicate matching nothing returns no rows
    kb = chunk_rows[0]["kbId"]
    assert [i for _, i in sorted(by[3])] == brute(chunk_rows, q, 5, lambda r: r["kbId"] == kb)


def test_fewer_hits_than_k_and_k_beyond_corpus(chunks, chunk_rows):
    r = chunk_rows[2]
    where = (F.col("kbId") == r["kbId"]) & (F.col("site") == r["site"]) & (F.col("study") == r["study"])
    n = chunks.filter(where).count()
    got = search(chunks, r["embedding"], where, k=10 ** 6, fields=())
    assert got.count() == n
    assert search(chunks, r["embedding"], None, k=0, fields=()).count() == 0


def test_ties_broken_by_id(spark):
    rows = [(i, [1.0, 0.0]) for i in (5, 3, 9, 1)] + [(7, [0.5, 0.0])]
    c = spark.createDataFrame(rows, "id long, embedding array<float>")
    got = search(c, [1.0, 0.0], None, k=3, fields=()).orderBy("rank").collect()
    assert [r["id"] for r in got] == [1, 3, 5]
    qs = spark.createDataFrame([(1, [1.0, 0.0])], "qid long, q_dense array<float>")
    got2 = search_batch(c, qs, k=3, fields=(), pred_fields=[]).orderBy("rank").collect()
    assert [r["id"] for r in got2] == [1, 3, 5]


def test_document_in_semi_join(spark, chunks, chunk_rows):
    ids = spark.createDataFrame([("doc_00000001",), ("doc_99999999",)], "documentId string")
    got = search(chunks, chunk_rows[0]["embedding"], None, k=10, fields=("documentId",),
                 semi=(F.broadcast(ids), "documentId")).collect()
    assert [r["documentId"] for r in got] == ["doc_00000001"]
    empty = spark.createDataFrame([], "documentId string")
    assert search(chunks, chunk_rows[0]["embedding"], None, k=10, fields=(),
                  semi=(empty, "documentId")).count() == 0


def test_query_slices_when_over_budget(spark, chunks, chunk_rows):
    qs = spark.createDataFrame([(i, chunk_rows[i]["embedding"]) for i in range(6)],
                               "qid long, q_dense array<float>")
    small = search_batch(chunks, qs, k=4, fields=(), pred_fields=[], max_query_bytes=1200)
    big = search_batch(chunks, qs, k=4, fields=(), pred_fields=[])
    key = lambda d: sorted((r["qid"], r["rank"], r["id"]) for r in d.collect())
    assert key(small) == key(big)


def test_same_rows_under_any_shuffle_partitioning(spark, chunks, chunk_rows):
    from filtra.plans.catalog import group_queries
    res = []
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 4, 16):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            d = search_batch(chunks, group_queries(chunks), k=5, fields=())
            res.append(sorted(tuple(r) for r in d.collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert res[0] == res[1] == res[2]


@pytest.mark.parametrize("metric", ["IP", "L2", "COSINE"])
def test_r1_kernel_method_equals_expression(chunks, chunk_rows, metric):
    q = chunk_rows[9]["embedding"]
    where = F.col("kbId") == chunk_rows[9]["kbId"]
    a = search(chunks, q, where, k=8, metric=metric, method="expr").orderBy("rank").collect()
    b = search(chunks, q, where, k=8, metric=metric, method="kernel").orderBy("rank").collect()
    assert [tuple(r) for r in a] == [tuple(r) for r in b]


def test_high_dimension_routes_to_kernel(spark):
    import numpy as np
    rng = np.random.default_rng(3)
    vecs = rng.standard_normal((300, 512)).astype(np.float32)
    c = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "id long, embedding array<float>")
    q = vecs[17].tolist()
    auto = search(c, q, None, k=5, fields=())
    plan = auto._jdf.queryExecution().executedPlan().toString()
    assert "PythonMapInArrow" in plan or "MapInArrow" in plan
    exp = search(c, q, None, k=5, fields=(), method="expr")
    assert [tuple(r) for r in auto.orderBy("rank").collect()] == [tuple(r) for r in exp.orderBy("rank").collect()]


def test_kernel_slices_large_arrow_batches(spark, chunks, chunk_rows):
    from filtra.operators import search as S
    old = S.KERNEL_ROWS
    qs = spark.createDataFrame([(i, chunk_rows[i]["embedding"]) for i in range(3)],
                               "qid long, q_dense array<float>")
    ref = sorted(tuple(r) for r in search_batch(chunks, qs, k=6, fields=(), pred_fields=[]).collect())
    try:
        S.KERNEL_ROWS = 7
        got = sorted(tuple(r) for r in search_batch(chunks, qs, k=6, fields=(), pred_fields=[]).collect())
    finally:
        S.KERNEL_ROWS = old
    assert got == ref


def test_kernel_equals_expression_for_near_copies_and_ties(spark):
    import numpy as np
    from filtra.operators.search import search
    rng = np.random.default_rng(5)
    base = rng.normal(size=512) * 100
    rows = [(0, base.tolist()), (1, (base + 1e-4).tolist()), (2, (base * 1.001).tolist()), (3, rng.normal(size=512).tolist())]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    for metric in ("L2", "IP", "COSINE"):
        a = search(df, base.tolist(), k=4, metric=metric, fields=(), method="expr").collect()
        b = search(df, base.tolist(), k=4, metric=metric, fields=(), method="kernel").collect()
        assert [(r["rank"], r["id"]) for r in a] == [(r["rank"], r["id"]) for r in b]
        assert all(abs(x["score"] - y["score"]) <= 1e-6 * max(1, abs(x["score"])) for x, y in zip(a, b))
    assert search(df, base.tolist(), k=1, metric="L2", fields=(), method="kernel").first()["score"] == 0.0
    half = spark.createDataFrame([(1, [0.0078125]), (2, [0.007813])], "id long, embedding array<double>")
    for method in ("expr", "kernel"):
        got = search(half, [1.0], k=2, fields=(), method=method).collect()
        assert [(r["id"], r["score"]) for r in got] == [(1, 0.007813), (2, 0.007813)]
