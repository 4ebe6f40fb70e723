import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from filtra.operators import stats as S
from filtra.operators.ordering import row_index, running_sum


def skewed(spark, n=3000):
    # key 0 holds a third of all rows
    rows = [(0 if i % 3 == 0 else 1 + i % 7, (i * 7919) % 1000, i) for i in range(n)]
    return spark.createDataFrame(rows, "k int, t int, uid long")


@pytest.mark.parametrize("blocks", [1, 3, 16])
def test_row_index_equals_row_number(spark, blocks):
    df = skewed(spark)
    got = row_index(df, ["k"], ["t", "uid"], "rn", blocks=blocks)
    ref = df.withColumn("ref", F.row_number().over(Window.partitionBy("k").orderBy("t", "uid")))
    j = got.join(ref, ["k", "t", "uid"])
    assert j.count() == 3000
    assert j.filter("rn != ref").count() == 0


def test_running_sum_exclusive(spark):
    df = skewed(spark).withColumn("v", F.col("uid") % 5)
    got = running_sum(df, ["k"], ["uid"], "v", "s", exclusive=True, blocks=5)
    w = Window.partitionBy("k").orderBy("uid").rowsBetween(Window.unboundedPreceding, -1)
    ref = df.withColumn("ref", F.coalesce(F.sum("v").over(w), F.lit(0)))
    assert got.join(ref, ["k", "uid"]).filter("s != ref").count() == 0


def test_exact_percentiles_match_numpy(spark):
    rng = np.random.default_rng(1)
    vals = rng.gamma(2.0, 10.0, size=1001).round(2)
    rows = [("a" if i % 3 else "b", float(v)) for i, v in enumerate(vals)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r["g"]: r for r in S.exact_percentiles(df, ["g"], "x", (0.5, 0.95, 0.99),
                                                  ("p50", "p95", "p99")).collect()}
    for g in ("a", "b"):
        arr = np.array([v for k, v in rows if k == g])
        for p, n in ((50, "p50"), (95, "p95"), (99, "p99")):
            assert got[g][n] == pytest.approx(float(np.percentile(arr, p)), rel=1e-12)


def test_latency_summary_zero_for_missing_labels(spark):
    samples = spark.createDataFrame([("q1", 1.0), ("q1", 3.0)], "query string, latency_ms double")
    labels = spark.createDataFrame([("q1",), ("q2",)], "query string")
    got = {r["query"]: r for r in S.latency_summary(samples, ["query"], labels=labels).collect()}
    assert got["q1"]["n"] == 2 and got["q1"]["p50_ms"] == 2.0 and got["q1"]["max_ms"] == 3.0
    assert got["q2"]["n"] == 0 and got["q2"]["p99_ms"] == 0.0


def test_phase_summary_reproduces_report_totals(spark):
    # the four published phases of the collection-limit run: (phase, created, wall seconds)
    totals = spark.createDataFrame([(1, 5000, 99.2), (2, 15000, 420.1), (3, 30000, 2568.1),
                                    (4, 15536, 2526.3)], "phase int, n long, wall_s double")
    rows = {r["phase"]: r for r in S.phase_summary(totals).collect()}
    assert rows[None]["n"] == 65536
    assert rows[None]["wall_s"] == pytest.approx(5613.7)
    assert rows[None]["rate"] == pytest.approx(11.7)
    assert [rows[p]["start"] for p in (1, 2, 3, 4)] == [0, 5000, 20000, 50000]
    assert [rows[p]["rate"] for p in (1, 2, 3, 4)] == [50.4, 35.7, 11.7, 6.1]


def test_latency_trend_ratios_of_report_rows(spark):
    # published create / list p50 at 5,000 and 60,000 collections
    rows = [(5000, "sample", 17.0, 1.2), (60000, "sample", 44.0, 30.0)]
    created = spark.createDataFrame(rows, "created_so_far long, event string, create_ms double, "
                                          "list_ms double")
    got = {r["bucket"]: r for r in S.latency_trend(created, step=5000).collect()}
    assert round(got[60000]["create_p50_ratio"], 1) == 2.6
    assert round(got[60000]["list_p50_ratio"], 1) == 25.0


def test_throughput_floor_one_second(spark):
    from datetime import datetime
    log = spark.createDataFrame([(1, datetime(2024, 1, 1)), (1, datetime(2024, 1, 1))],
                                "concurrency int, ts timestamp")
    r = S.throughput(log).first()
    assert r["requests"] == 2 and r["window_s"] == 1.0 and r["qps"] == 2.0


def test_numbering_with_many_blocks_and_null_keys(spark):
    from filtra.operators.ordering import row_index, running_sum
    rows = [(None if i % 7 == 0 else i % 3, (i * 37) % 1000, i) for i in range(1000)]
    df = spark.createDataFrame(rows, "p int, o int, v long")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "5000")
    try:
        numbered = row_index(df, ["p"], ["o"], "n").collect()
        summed = running_sum(df, ["p"], ["o"], "v", "s").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want_n, want_s = {}, {}
    for key in {r[0] for r in rows}:
        total = 0
        for n, r in enumerate(sorted((x for x in rows if x[0] == key), key=lambda x: x[1]), 1):
            total += r[2]
            want_n[r[2]], want_s[r[2]] = n, total
    assert {r.v: r.n for r in numbered} == want_n
    assert {r.v: r.s for r in summed} == want_s


def test_null_label_keeps_its_samples(spark):
    from filtra.operators.stats import latency_summary
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 2.0)], "label string, latency_ms double")
    labels = spark.createDataFrame([(None,), ("a",), ("b",)], "label string")
    got = {r["label"]: (r["n"], r["p50_ms"]) for r in latency_summary(df, ["label"], labels=labels).collect()}
    assert got == {None: (2, 2.0), "a": (1, 2.0), "b": (0, 0.0)}


def test_weighted_percentiles_equal_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(None if k == 3 else f"k{k}", float(rng.integers(0, 40)) if rng.random() > 0.05 else None)
            for k in (0, 0, 0, 1, 2, 3) for _ in range(150)] + [("one", 5.0), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    counted = df.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"))
    probs, names = (0.0, 0.37, 0.5, 0.99, 1.0), ("a", "b", "c", "d", "e")
    want = {r["k"]: tuple(r)[1:] for r in S.exact_percentiles(df, ["k"], "v", probs, names).collect()}
    got = {r["k"]: tuple(r)[1:] for r in S.weighted_percentiles(counted, ["k"], "v", "n", probs, names).collect()}
    assert got.keys() == want.keys() and "none" not in got
    for k in want:
        assert got[k] == pytest.approx(want[k])


def test_nothing_counts_after_the_first_failure(spark):
    rows = [(1, 1, "sample"), (1, 2, "create_failed"), (1, 3, "sample"), (1, 4, "create_failed"),
            (2, 1, "sample"), (2, 2, "sample"), (3, 1, "create_failed")]
    df = spark.createDataFrame(rows, "phase int, iteration long, event string").withColumn(
        "elapsed_s", F.col("iteration").cast("double"))
    kept = S.until_failure(df)
    assert sorted((r["phase"], r["iteration"]) for r in kept.collect()) == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 1)]
    totals = {r["phase"]: r["n"] for r in S.phase_totals(kept).collect()}
    assert totals == {1: 1, 2: 2, 3: 0}

