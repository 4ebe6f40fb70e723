import math

import pytest
from pyspark.sql import functions as F

from filtra.sources import generator as G


def docs(spark, n=40):
    return spark.range(n).withColumnRenamed("id", "doc_id")


def test_chunk_expand_contiguous_ids_and_shared_attributes(spark):
    ch = G.chunk_expand(docs(spark), lo=2, hi=6, start_id=100)
    rows = ch.collect()
    ids = sorted(r["id"] for r in rows)
    assert ids == list(range(100, 100 + len(rows)))
    per_doc = {}
    for r in rows:
        per_doc.setdefault(r["documentId"], set()).add((r["kbId"], r["study"], r["site"],
                                                        r["patient"], r["visit"], r["n"]))
    assert all(len(v) == 1 for v in per_doc.values())
    assert all(2 <= next(iter(v))[5] <= 6 for v in per_doc.values())


def test_total_rows_cuts_last_document(spark):
    full = G.chunk_expand(docs(spark), lo=3, hi=9)
    total = full.count()
    cut = G.chunk_expand(docs(spark), lo=3, hi=9, total_rows=total - 2)
    assert cut.count() == total - 2
    assert cut.agg(F.max("id")).first()[0] == total - 3


def test_min_equals_max_and_invalid_ranges(spark):
    assert G.chunk_expand(docs(spark, 5), lo=4, hi=4).count() == 20
    with pytest.raises(ValueError):
        G.chunk_expand(docs(spark), lo=0, hi=5)
    with pytest.raises(ValueError):
        G.chunk_expand(docs(spark), lo=5, hi=3)


def test_zipf_shares_follow_rank_and_alpha_zero_is_uniform(spark):
    d = spark.range(20000).withColumnRenamed("id", "doc_id")
    counts = {r["v"]: r["count"] for r in
              d.select(G.zipf_assign("doc_id", "kbId", 10, 1.0).alias("v")).groupBy("v").count().collect()}
    h = sum(1 / r for r in range(1, 11))
    assert counts["kb_00"] / 20000 == pytest.approx(1 / h, abs=0.02)
    assert counts["kb_00"] > counts["kb_05"] > 0
    uni = {r["v"]: r["count"] for r in
           d.select(G.zipf_assign("doc_id", "kbId", 10, 0.0).alias("v")).groupBy("v").count().collect()}
    assert len(uni) == 10 and max(uni.values()) / min(uni.values()) < 1.2


def test_dense_vectors_unit_length(spark):
    v = spark.range(50).select(G.dense_vectors("id", 16).alias("e")).collect()
    for r in v:
        assert len(r["e"]) == 16
        assert math.isclose(math.sqrt(sum(x * x for x in r["e"])), 1.0, rel_tol=1e-5)


def test_sparse_vectors_distinct_in_range(spark):
    rows = spark.range(30).select(G.sparse_vectors("id", vocab=1000, nnz=64).alias("m")).collect()
    for r in rows:
        assert len(r["m"]) == 64
        assert all(0 <= t < 1000 for t in r["m"]) and all(0 < w < 1 for w in r["m"].values())
    small = spark.range(3).select(G.sparse_vectors("id", vocab=10, nnz=64).alias("m")).collect()
    assert all(sorted(r["m"]) == list(range(10)) for r in small)


def test_value_pools_formats(spark):
    p = {(r["field"], r["pos"]): r["value"] for r in G.value_pools(spark).collect()}
    assert p[("kbId", 0)] == "kb_00" and p[("study", 5)] == "S005"
    assert p[("site", 29)] == "SITE_029" and p[("patient", 12)] == "P00012" and p[("visit", 2)] == "V02"


def test_fixture_counts_at_sf001(spark):
    g = G.generated_chunks(spark, "/root/testdata/sf0.01", with_vectors=False)
    assert g.count() == 257124
    kb = {r["kbId"]: r["n"] for r in g.groupBy("kbId").agg(F.countDistinct("documentId").alias("n")).collect()}
    assert [kb[f"kb_{i:02d}"] for i in range(10)] == [352, 167, 107, 89, 76, 45, 49, 35, 40, 40]


def test_vectors_of_any_dimension(spark):
    df = spark.range(20).select("id", G.dense_vectors("id", 300).alias("e"))
    rows = df.collect()
    for r in rows:
        assert len(r["e"]) == 300
        assert math.isclose(math.sqrt(sum(x * x for x in r["e"])), 1.0, rel_tol=1e-5)
    assert len({tuple(r["e"][:4]) for r in rows}) == 20


def test_expression_and_function_give_the_same_vectors(spark):
    df = spark.range(50).select(G.dense_vectors("id", 8).alias("a"), G.dense_vectors(F.col("id"), 8).alias("b"))
    for r in df.collect():
        assert all(math.isclose(x, y, abs_tol=1e-7) for x, y in zip(r["a"], r["b"]))


def test_expansion_spreads_rows_over_tasks(spark):
    ch = G.chunk_expand(docs(spark, 200), lo=100, hi=100, rows_per_task=1000)
    assert ch.rdd.getNumPartitions() >= 10


# ------------------------------------------------------------- clustered layout

def test_clustered_layout_skips_row_groups(spark, tmp_path):
    """Fewer row groups can hold a field's value than in id order; rows and results are the same."""
    import glob
    import pyarrow.parquet as pq
    from filtra.sources.sinks import write_clustered, write_corpus
    rows = [(i, f"kb_{i % 2}", f"d{i}", f"S{(i * 7919) % 30:02d}", f"T{(i * 104729) % 29:02d}", f"P{(i * 31) % 28:02d}",
             f"V{(i * 17 + i // 29) % 27:02d}" if i % 50 else None, "filler text " * 8 + str(i * 7919 % 9973)) for i in range(12000)]
    df = spark.createDataFrame(rows, "id long, kbId string, documentId string, study string, site string, patient string,"
                                     " visit string, content string").coalesce(1)
    a, b = str(tmp_path / "plain"), str(tmp_path / "clustered")
    write_corpus(df, a)
    write_clustered(df, b, row_group_bytes=16 << 10)
    spark.read.parquet(a)

    def groups(path):
        out = []
        for f in glob.glob(f"{path}/kbId=*/*.parquet"):
            meta = pq.ParquetFile(f).metadata
            for g in range(meta.num_row_groups):
                cols = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c).statistics
                        for c in range(meta.num_columns)}
                out.append({k: (s.min, s.max) for k, s in cols.items() if s is not None and s.has_min_max})
        return out

    clustered = groups(b)
    assert len(clustered) >= 16
    for field, value in (("study", "S07"), ("site", "T11"), ("patient", "P13"), ("visit", "V05")):
        may = sum(1 for g in clustered if g[field][0] <= value <= g[field][1])
        assert may <= 0.7 * len(clustered), (field, may, len(clustered))
    both = sum(1 for g in clustered if all(g[f][0] <= v <= g[f][1] for f, v in
                                           (("study", "S07"), ("site", "T11"), ("patient", "P13"), ("visit", "V05"))))
    assert both <= 0.25 * len(clustered)
    back = spark.read.parquet(b)
    assert sorted(back.columns) == sorted(df.columns)
    key = sorted(df.columns)
    assert back.select(key).exceptAll(df.select(key)).count() == 0 and back.count() == 12000


def test_interleaved_bits(spark):
    from filtra.sources.sinks import interleaved
    df = spark.range(16).selectExpr("id % 4 as a", "id div 4 as b")
    got = {(r["a"], r["b"]): r["z"] for r in df.select("a", "b", interleaved(["a", "b"], 2).alias("z")).collect()}
    for (a, b), z in got.items():
        assert z == sum(((a >> i) & 1) << (2 * i) | ((b >> i) & 1) << (2 * i + 1) for i in range(2))


def test_writers_follow_rows(spark, tmp_path, monkeypatch):
    import glob
    from filtra.sources import sinks
    monkeypatch.setattr(sinks, "ROWS_PER_WRITER", 1000)
    df = spark.range(6000).selectExpr("id", "if(id % 3 = 0, 'hot', concat('kb', id % 40)) as kbId")
    sinks.write_corpus(df, str(tmp_path / "c"))
    hot = glob.glob(str(tmp_path / "c" / "kbId=hot" / "*.parquet"))
    assert 2 <= len(hot) <= 4 and len(glob.glob(str(tmp_path / "c" / "kbId=kb1" / "*.parquet"))) <= 2

