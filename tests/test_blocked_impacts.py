"""Block searches with bounds: equal to exact search, and reading less."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from filtra.operators import blocked, impacts
from filtra.operators.blocked import cell_bounds, ivf_search_exact, search_blocked
from filtra.operators.impacts import impact_search, posting_blocks, write_impacts
from filtra.operators.search import search_batch


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


# ----------------------------------------------------------------- R2

def drawn(spark, chunks, n=60):
    from filtra.plans.workload import workload_queries
    return workload_queries(chunks, n)


@pytest.mark.parametrize("metric", ["IP", "L2", "COSINE"])
def test_blocked_equals_batch(spark, chunks, metric, monkeypatch):
    q = drawn(spark, chunks)
    want = rows_of(search_batch(chunks, q, k=7, metric=metric))
    assert len(want) > 60
    assert rows_of(search_blocked(chunks, q, k=7, metric=metric)) == want
    # many blocks of rows and of queries
    monkeypatch.setattr(blocked, "BLOCK_BYTES", 8000)
    monkeypatch.setattr(blocked, "QUERY_BYTES", 9000)
    assert rows_of(search_blocked(chunks, q, k=7, metric=metric)) == want


def test_blocked_without_predicates_and_odd_rows(spark):
    rows = [(1, "a", [1.0, 0.0]), (2, None, [0.5, 0.5]), (3, "a", None), (4, "b", [1.0, 0.0]), (5, "b", [1.0]),
            (6, None, [0.0, 0.0])]
    c = spark.createDataFrame(rows, "id long, kbId string, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [1.0, 0.0], None), (3, None, "a"), (4, [0.0, 1.0], "zz")],
                              "qid long, q_dense array<float>, kbId string")
    got = rows_of(search_blocked(c, q, k=3, fields=("kbId",)))
    assert got == [(1, 1, 1, 1.0, "a"), (2, 1, 1, 1.0, "a"), (2, 2, 4, 1.0, "b"), (2, 3, 2, 0.5, None)]
    assert [r[:3] for r in rows_of(search_blocked(c, q.drop("kbId"), k=2, fields=()))] == [
        (1, 1, 1), (1, 2, 4), (2, 1, 1), (2, 2, 4), (4, 1, 2), (4, 2, 1)]
    assert search_blocked(c.limit(0), q, k=2, fields=()).count() == 0
    assert search_blocked(c, q.limit(0), k=2, fields=()).count() == 0


def test_no_query_reaches_the_driver(spark, chunks):
    plan = search_blocked(chunks, drawn(spark, chunks), k=3)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


# ----------------------------------------------------------------- R4

def clustered(spark, n=600, dim=6, cells=12, spread=0.15, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(cells, dim)) * 3
    own = rng.integers(0, cells, n)
    v = centres[own] + rng.normal(size=(n, dim)) * spread
    index = spark.createDataFrame([(int(i), int(c), "a" if i % 3 else "b", [float(x) for x in r])
                                   for i, (c, r) in enumerate(zip(own, v, strict=True))],
                                  "id long, cell int, kbId string, embedding array<float>")
    cents = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centres)],
                                  "cell int, center array<float>")
    q = spark.createDataFrame([(i, [float(x) for x in v[rng.integers(0, n)]], rng.choice(["a", "b", None]))
                               for i in range(25)], "qid long, q_dense array<float>, kbId string")
    return index, cents, q


@pytest.mark.parametrize("metric", ["IP", "L2", "COSINE"])
def test_bounded_probe_equals_exact_and_reads_less(spark, metric):
    index, cents, q = clustered(spark)
    hits, reads = ivf_search_exact(index, cell_bounds(index, cents), q, k=5, metric=metric, fields=("kbId",), first=1)
    assert rows_of(hits) == rows_of(search_batch(index, q, k=5, metric=metric, fields=("kbId",)))
    r = reads.agg(F.sum("cells_read").alias("read"), F.sum("cells_total").alias("total")).first()
    assert r["total"] == 25 * 12 and r["read"] < r["total"] / 2


def test_bounds_hold_for_every_row(spark):
    """No row scores above its cell's bound, whatever the vectors."""
    from filtra.functions.vectors import score_expr
    rng = random.Random(1)
    index = spark.createDataFrame([(i, i % 5, [rng.gauss(0, 1) * 10 ** rng.uniform(-3, 3) for _ in range(4)])
                                   for i in range(200)] + [(900, 2, [0.0] * 4)],
                                  "id long, cell int, embedding array<float>")
    cents = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(5)], "cell int, center array<float>")
    q = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(10)], "qid long, q_dense array<float>")
    cells = cell_bounds(index, cents)
    for metric in ("IP", "L2", "COSINE"):
        b = blocked._query_cell_bounds(cells, q, metric)
        s = index.join(b, "cell").join(q, "qid").select(
            score_expr(metric, "embedding", F.col("q_dense")).alias("s"), "bound")
        low = "s < bound - 4e-6" if metric == "L2" else "s > bound + 4e-6"
        assert s.count() == 2010 and s.filter(low).count() == 0


# ----------------------------------------------------------------- R5 over maps

def brute_maps(docs, queries, k, same):
    out = []
    for qid, qmap, values in queries:
        found = []
        for i, dmap, fields in docs:
            if dmap and all(values.get(f) is None or values[f] == fields.get(f) for f in same):
                both = [t for t in dmap if t in qmap and dmap[t] is not None and qmap[t]]
                if both:
                    found.append((round(sum(float(np.float32(dmap[t])) * qmap[t] for t in both), 6), i))
        for rank, (s, i) in enumerate(sorted(found, key=lambda x: (-x[0], x[1]))[:k], 1):
            out.append((qid, rank, i, s))
    return sorted(out)


def maps(spark, seed, n=400, vocab=60):
    rng = random.Random(seed)
    # weights on a grid, so that sums are exact and ties occur; some negative
    def one(m):
        return {t: rng.randint(-2, 12) / 4 for t in rng.sample(range(vocab), rng.randint(0, m))}
    docs = [(i * 3 - 50, one(10) if i % 17 else None,
             {"kbId": rng.choice(["a", "a", "a", "b", None]), "site": rng.choice("xy")}) for i in range(n)]
    queries = [(i, one(8), {"kbId": rng.choice(["a", "b", None]), "site": rng.choice(["x", None])}) for i in range(30)]
    d = spark.createDataFrame([(i, m, f["kbId"], f["site"]) for i, m, f in docs],
                              "id long, sparse_embedding map<int,float>, kbId string, site string")
    q = spark.createDataFrame([(i, m, f["kbId"], f["site"]) for i, m, f in queries],
                              "qid long, q_sparse map<int,double>, kbId string, site string")
    return docs, queries, d, q


@pytest.mark.parametrize("span,first", [(16, 1), (64, 4), (100000, 1)])
def test_impacts_equal_brute_force(spark, tmp_path, span, first):
    docs, queries, d, q = maps(spark, span)
    index = posting_blocks(d, span=span)
    hits, _ = impact_search(index, q, k=5, first=first)
    assert rows_of(hits) == brute_maps(docs, queries, 5, ())
    write_impacts(index, str(tmp_path / "ix"), buckets=8)
    stored = spark.read.parquet(str(tmp_path / "ix"))
    hits, _ = impact_search(stored, q, k=5, first=first, docs=d, pred_fields=("kbId", "site"))
    assert rows_of(hits) == brute_maps(docs, queries, 5, ("kbId", "site"))


def test_impacts_skip_blocks(spark):
    """Blocks of ids whose weights are low are not read: their bound is below the k-th score."""
    rng = random.Random(4)
    d = spark.createDataFrame([(i, {t: (5.0 if i < 40 else 0.1) * rng.random() for t in rng.sample(range(20), 8)}, "a")
                               for i in range(2000)], "id long, sparse_embedding map<int,double>, kbId string")
    q = spark.createDataFrame([(1, {t: 1.0 for t in range(10)})], "qid long, q_sparse map<int,double>")
    hits, reads = impact_search(posting_blocks(d, span=20), q, k=5, first=1)
    r = reads.first()
    assert r["units_total"] == 100 and r["units_read"] <= 4
    assert all(h["id"] < 40 for h in hits.collect())


def test_impacts_empty_and_missing(spark, tmp_path):
    _, _, d, q = maps(spark, 9)
    empty, _ = impact_search(posting_blocks(d.limit(0)), q, k=5)
    assert empty.collect() == []
    none, reads = impact_search(posting_blocks(d), q.limit(0), k=5)
    assert none.collect() == [] and reads.collect() == []
    write_impacts(posting_blocks(d.limit(0)), str(tmp_path / "none"))
    with pytest.raises(ValueError):
        impact_search(posting_blocks(d), q, pred_fields=("site",))
    with pytest.raises(ValueError):
        posting_blocks(d, span=0)


def test_bounds_join_does_not_read_the_lists(spark, tmp_path):
    _, _, d, q = maps(spark, 2)
    write_impacts(posting_blocks(d), str(tmp_path / "ix"), buckets=4)
    index = spark.read.parquet(str(tmp_path / "ix"))
    terms = impacts.query_terms(q)
    posts, terms, keys = impacts._pruned(index, terms)
    plan = posts.drop("docs").join(terms, keys)._jdf.queryExecution().executedPlan().toString()
    schema = plan[plan.index("ReadSchema"):].split("\n")[0]
    assert "docs" not in schema and "max_w" in schema


def test_no_pair_of_query_and_document_is_shuffled(spark, monkeypatch):
    """what leaves the co-groups is k rows and one count for each pair of query and slice,
    however many documents share a token with the query."""
    rng = random.Random(6)
    d = spark.createDataFrame([(i, {t: rng.randint(1, 9) / 4 for t in range(6)}, "a" if i % 2 else None)
                               for i in range(600)], "id long, sparse_embedding map<int,float>, kbId string")
    q = spark.createDataFrame([(i, {t: float(i % 3 + 1) for t in range(6)}) for i in range(20)],
                              "qid long, q_sparse map<int,double>")
    want = rows_of(impact_search(posting_blocks(d, span=16), q, k=5)[0])
    assert len(want) == 100
    sent = []
    ranked = impacts.topk
    monkeypatch.setattr(impacts, "topk", lambda df, *a, **b: sent.append(df.count()) or ranked(df, *a, **b))
    monkeypatch.setattr(impacts, "SLICE_BYTES", 20_000)
    monkeypatch.setattr(impacts, "QUERY_BYTES", 500)
    assert rows_of(impact_search(posting_blocks(d, span=16), q, k=5)[0]) == want
    assert 100 < sent[0] <= 20 * 6 * 5 < 20 * 600


def test_repeated_rows_count_as_often_as_they_occur(spark):
    """A repeated document adds to its postings and fields, a repeated query to its terms."""
    d = spark.createDataFrame([(1, {3: 2.0}, "a", "x"), (1, {3: 2.0}, "a", "x"), (2, {3: 1.0}, "a", "x"), (3, {3: 9.0}, "a", "y")],
                              "id long, sparse_embedding map<int,float>, kbId string, site string")
    q = spark.createDataFrame([(7, {3: 1.0}, "x"), (7, {3: 1.0}, "x"), (None, {3: 1.0}, "x")],
                              "qid long, q_sparse map<int,double>, site string")
    hits, _ = impact_search(posting_blocks(d), q, k=9, docs=d, pred_fields=("site",))
    # documents twice and queries twice: the joins repeat a hit as they repeat its rows
    assert rows_of(hits) == [(7, 1, 1, 8.0), (7, 2, 1, 8.0), (7, 3, 1, 8.0), (7, 4, 1, 8.0), (7, 5, 2, 2.0), (7, 6, 2, 2.0)]
    assert rows_of(impact_search(posting_blocks(d), q, k=9)[0]) == [(7, 1, 3, 18.0), (7, 2, 1, 8.0), (7, 3, 2, 2.0)]


def test_only_the_hits_of_all_slices_are_stored(spark, monkeypatch):
    """what the slices found, k rows for each pair of query and slice, is read once and never stored;
    index rows travel packed, a row for each slice and group that a task holds."""
    rng = random.Random(8)
    d = spark.createDataFrame([(i, {t: rng.randint(1, 9) / 4 for t in range(6)}, "a" if i % 2 else None)
                               for i in range(600)], "id long, sparse_embedding map<int,float>, kbId string")
    q = spark.createDataFrame([(i, {t: float(i % 3 + 1) for t in range(6)}) for i in range(20)],
                              "qid long, q_sparse map<int,float>")
    want = rows_of(impact_search(posting_blocks(d, span=16), q, k=5)[0])
    stored, packed = [], []
    keep, pack = impacts.persist_index, impacts._pack_rows
    monkeypatch.setattr(impacts, "persist_index", lambda df: stored.append(keep(df)) or stored[-1])
    monkeypatch.setattr(impacts, "SLICE_BYTES", 20_000)
    assert rows_of(impact_search(posting_blocks(d, span=16), q, k=5)[0]) == want
    assert max(x.count() for x in stored if "qid" in x.columns) == 20 * 5
    t = posting_blocks(d, span=16).selectExpr("0L kb", "pmod(block, 3) slice", "grp", "block", "token", "docs.id ids",
                                              "docs.w ws", "max_w", "min_w").toArrow()
    packed = pack(t)
    assert t.num_rows > 400 and packed.num_rows == 6
    assert sum(len(x) for x in packed.column("ids").to_pylist()) == 8 * 3600
