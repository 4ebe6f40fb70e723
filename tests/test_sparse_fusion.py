import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from filtra.operators.fusion import rrf, weighted
from filtra.operators.sparse import bm25_postings, sparse_search


DOCS = [(1, "The cat sat on the mat. The end!"), (2, "A dog; the DOG barked at the cat"),
        (3, ""), (4, "mat mat mat"), (5, "école à l'eau 42")]


def py_bm25(docs, k1=1.2, b=0.75):
    toks = {i: [t for t in re.split(r"[^a-z0-9]+", s.lower()) if t] for i, s in docs}
    n = len(docs)
    avgdl = sum(len(t) for t in toks.values()) / n
    df = Counter(t for ts in toks.values() for t in set(ts))
    out = {}
    for i, ts in toks.items():
        for t, tf in Counter(ts).items():
            idf = math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))
            out[(i, t)] = idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(ts) / avgdl))
    return out


@pytest.mark.parametrize("max_hot", [1, 3, 10 ** 9])
def test_bm25_matches_formula_and_hot_split(spark, max_hot):
    docs = spark.createDataFrame(DOCS, "id long, content string")
    got = {(r["id"], r["token"]): r["weight"]
           for r in bm25_postings(docs, max_hot=max_hot).collect()}
    exp = py_bm25(DOCS)
    assert set(got) == set(exp)
    for k, v in exp.items():
        assert got[k] == pytest.approx(v, rel=1e-12)


def test_sparse_search_filters_before_ranking(spark):
    post = spark.createDataFrame([(1, "a", 1.0), (2, "a", 2.0), (3, "a", 3.0), (3, "b", 1.0)],
                                 "id long, token string, weight double")
    terms = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("zz", 9.0)], "token string, qweight double")
    allowed = spark.createDataFrame([(1,), (2,)], "id long")
    got = sparse_search(post, terms, k=5, allowed_ids=allowed).orderBy("rank").collect()
    assert [(r["id"], r["score"]) for r in got] == [(2, 2.0), (1, 1.0)]
    none = spark.createDataFrame([("q",), ], "token string").selectExpr("token", "1.0 as qweight")
    assert sparse_search(post, none, k=5).count() == 0


def _arm(spark, rows):
    return spark.createDataFrame(rows, "id long, rank long, score double")


def test_rrf_formula_and_single_arm_docs(spark):
    dense = _arm(spark, [(10, 1, 0.9), (11, 2, 0.8), (12, 3, 0.7)])
    sparse = _arm(spark, [(12, 1, 5.0), (13, 2, 4.0)])
    got = {r["id"]: (r["rank"], r["score"]) for r in rrf([dense, sparse], k=10).collect()}
    assert got[12][1] == pytest.approx(round(1 / 63 + 1 / 61, 6))
    assert got[13][1] == pytest.approx(round(1 / 62, 6))
    assert got[10][1] == pytest.approx(round(1 / 61, 6))
    assert got[12][0] == 1
    assert len(rrf([dense, sparse], k=2).collect()) == 2


def test_weighted_none_and_minmax(spark):
    dense = _arm(spark, [(1, 1, 0.9), (2, 2, 0.5)])
    sparse = _arm(spark, [(2, 1, 10.0), (3, 2, 6.0)])
    plain = {r["id"]: r["score"] for r in weighted([(dense, 1.0), (sparse, 1.0)]).collect()}
    assert plain == {1: 0.9, 2: 10.5, 3: 6.0}
    mm = {r["id"]: r["score"] for r in weighted([(dense, 1.0), (sparse, 0.5)], norm="minmax").collect()}
    assert mm == {1: 1.0, 2: 0.5, 3: 0.0}
    zero = {r["id"]: r["score"] for r in weighted([(dense, 0.0), (sparse, 1.0)]).collect()}
    assert zero[1] == 0.0 and zero[2] == 10.0
    with pytest.raises(ValueError):
        weighted([(dense, 1.0)], norm="zscore")


def test_row_form_equals_posting_form(spark):
    from filtra.functions.vectors import sparse_inner_product
    from filtra.operators.sparse import query_terms, sparse_rows, sparse_scores, terms_literal
    docs = spark.createDataFrame(DOCS, "id long, content string")
    post = bm25_postings(docs)
    terms = query_terms(post, 1)
    posting = {r["id"]: r["score"] for r in sparse_scores(post, terms).collect()}
    rows = sparse_rows(post).select("id", sparse_inner_product("vec", terms_literal(terms)).alias("s"))
    row_form = {r["id"]: round(r["s"], 6) for r in rows.collect() if r["s"] != 0}
    assert row_form == posting


def test_stored_postings_prune_token_buckets(spark):
    from filtra.operators.sparse import query_terms, sparse_scores, write_postings
    from filtra.session import scratch_path
    docs = spark.createDataFrame(DOCS, "id long, content string")
    post = bm25_postings(docs)
    path = scratch_path(spark, "t-post")
    write_postings(post, path, buckets=8)
    stored = spark.read.parquet(path)
    terms = query_terms(post, 2)
    res = sparse_scores(stored, terms, buckets=8)
    a = {r["id"]: r["score"] for r in res.collect()}
    final = res._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    scans = [l for l in final.splitlines() if "t-post" in l and "PartitionFilters" in l]
    assert scans and all(re.search(r"PartitionFilters: \[[^\]]*tb[^\]]* IN ", l) for l in scans), scans
    b = {r["id"]: r["score"] for r in sparse_scores(post, terms).collect()}
    assert a == b


def test_query_restricted_weights_equal_full_index(spark):
    from filtra.operators.sparse import bm25_for_tokens, term_stats
    docs = spark.createDataFrame(DOCS, "id long, content string")
    full = {(r["id"], r["token"]): r["weight"] for r in bm25_postings(docs).collect()}
    tf, n, avgdl = term_stats(docs)
    part = bm25_for_tokens(tf, n, avgdl, tf.filter("id = 2"))
    got = {(r["id"], r["token"]): r["weight"] for r in part.collect()}
    toks = {t for (i, t) in full if i == 2}
    assert got == {key: w for key, w in full.items() if key[1] in toks}


def test_stored_index_knows_its_bucket_count(spark, chunks, tmp_path):
    from filtra.operators.sparse import bm25_postings, persist_index, sparse_search, write_postings
    posts = persist_index(bm25_postings(chunks.select("id", "content")))
    terms = posts.groupBy("token").agg(F.lit(1.0).alias("qweight")).orderBy("token").limit(40)
    want = [tuple(r) for r in sparse_search(posts, terms, k=5).collect()]
    write_postings(posts, str(tmp_path / "ix"), buckets=16)
    got = [tuple(r) for r in sparse_search(spark.read.parquet(str(tmp_path / "ix")), terms, k=5).collect()]
    assert got == want


def test_text_queries_cover_documents_without_embedding(spark):
    """500 of the 1,000 documents have no embedding; their texts count as well."""
    import __spark_entry__ as e
    from testdirs import SF_MID
    from filtra.sources.tables import read_table, texts_view
    assert texts_view(spark, SF_MID).count() == read_table(spark, SF_MID, "documents").count() == 1000
    q = e.queries()
    covered = {r["id"] for r in q["bm25_weights"](spark, SF_MID).select("id").distinct().collect()}
    want = {r["doc_id"] for r in read_table(spark, SF_MID, "documents")
            .filter("lower(text) rlike '[a-z0-9]'").select("doc_id").collect()}
    assert covered == want


# ------------------------------------------------------------- segments

def _text_rows(spark):
    rows = [(i, t) for i, t in enumerate(["a b a", "", None, "B c, c; c", "a", "x1 y2 x1 Ünder", "!!", "b b b b a c"] * 4)]
    return spark.createDataFrame(rows, "id long, content string").withColumn("site", F.col("id") % 3)


def test_token_counts_equal_brute_force(spark):
    import re
    from collections import Counter
    from filtra.operators.segments import token_counts
    docs = _text_rows(spark)
    want = set()
    for r in docs.collect():
        toks = [t for t in re.split("[^a-z0-9]+", (r["content"] or "").lower()) if t]
        want |= {(r["id"], len(toks), t, n) for t, n in Counter(toks).items()}
    assert {tuple(r) for r in token_counts(docs).collect()} == want
    plan = token_counts(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_two_segments_equal_one_index(spark, tmp_path):
    from filtra.operators.segments import TextIndex
    from filtra.operators.sparse import bm25_postings
    docs = _text_rows(spark)
    whole, parts = TextIndex(spark, str(tmp_path / "a")), TextIndex(spark, str(tmp_path / "b"))
    whole.append(docs, "0", keep=("site",))
    parts.append(docs.filter("id < 11"), "0", keep=("site",))
    parts.append(docs.filter("id >= 11"), "1", keep=("site",))
    parts.append(docs.filter("id >= 11"), "1", keep=("site",))  # a repeated batch replaces itself
    parts.append(docs.limit(0), "2", keep=("site",))

    def rows(df):
        return sorted((r["id"], r["token"], r["tf"], round(r["weight"], 9)) for r in df.collect())

    assert whole.totals() == parts.totals() == (32, whole.totals()[1])
    assert rows(whole.weights()) == rows(parts.weights()) == rows(bm25_postings(docs))
    q = docs.filter("id in (0, 7)").select(F.col("id").alias("qid"), "content", "site")
    for same in ((), ("site",)):
        keep = ("qid", *same)
        got = [sorted(tuple(r) for r in ix.scores(ix.query_terms(q, keep=keep), same=same).collect())
               for ix in (whole, parts)]
        assert got[0] == got[1] and got[0]
        if same:
            site = {r["id"]: r["site"] for r in docs.collect()}
            assert all(site[qid] == site[i] for qid, i, _ in got[0])


def test_a_segment_is_stored_without_moving_postings(spark, tmp_path):
    from filtra.operators.segments import TextIndex, token_blocks, token_counts
    docs = _text_rows(spark).unionByName(spark.range(100, 101).select(
        "id", F.lit(" ".join(f"w{i} w{i % 7}" for i in range(60))).alias("content"), F.lit(1).cast("long").alias("site")))
    assert "Exchange" not in token_blocks(docs, keep=("id", "site"))._jdf.queryExecution().executedPlan().toString()
    ix = TextIndex(spark, str(tmp_path / "ix"))
    ix.append(docs, "0", keep=("site",))
    want = sorted(tuple(r) for r in token_counts(docs, keep=("id", "site")).collect())
    assert ix.postings().columns == ["id", "site", "dl", "token", "tf", "tb"]
    assert sorted(tuple(r)[:5] for r in ix.postings().collect()) == want
    # a row for each document and token bucket, whatever the number of postings
    stored = spark.read.parquet(str(tmp_path / "ix" / "postings"))
    assert stored.count() == ix.postings().select("id", "tb").distinct().count() < len(want)
    q = docs.filter("id = 0").select(F.col("id").alias("qid"), "content")
    plan = ix.scores(ix.query_terms(q))._jdf.queryExecution().executedPlan().toString()
    moved = [x for x in plan.split("\n") if "Exchange hashpartitioning" in x]
    assert moved and not any("tf#" in x for x in moved) and "SortMergeJoin" not in plan


def test_sparse_inner_product_moves_scores_not_maps(spark):
    """a text's map is scored where it is read; the join on the ids has its score alone."""
    from filtra.plans.catalog import QUERIES
    from testdirs import SF_SMALL
    plan = QUERIES["sparse_inner_product"](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() != "Join":
        plan = plan.children().head()
    assert plan.output().mkString(",").count("#") == 3 and "vec" not in plan.output().mkString(",")


@pytest.mark.parametrize("most", [0, 3, 200_000])
def test_weights_with_frequent_and_other_tokens_equal_the_full_index(spark, tmp_path, monkeypatch, most):
    """frequencies of the most frequent tokens are brought to the postings, the others' are joined."""
    from filtra.operators import segments
    monkeypatch.setattr(segments, "BROADCAST_TERMS", most)
    docs = spark.createDataFrame([(i, " ".join(f"t{j}" for j in range(20) if i % (j + 1) == 0)) for i in range(60)]
                                 + [(60, None), (61, "")], "id long, content string")
    index = segments.TextIndex(spark, str(tmp_path / f"ix{most}"))
    index.append(docs.filter("id < 30"), "0")
    index.append(docs.filter("id >= 30"), "1")
    rows = lambda df: sorted((r["id"], r["token"], r["tf"], round(r["weight"], 9)) for r in df.collect())
    got = index.weights()
    assert rows(got) == rows(bm25_postings(docs)) != []
    assert not most or "LeftAnti" in got._jdf.queryExecution().optimizedPlan().toString()
