from pyspark.sql import functions as F

from filtra.llm.common import cut


def _digits(df) -> int:
    return len(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def test_checkpoints_of_a_loop_carry_no_growing_size_estimate(spark):
    """the estimate of a join is a product; carried from round to round it doubled its digits
    until the driver's heap was full of them."""
    now = spark.range(50).withColumn("k", F.col("id") % 7).withColumn("n", F.when(F.col("id") % 2 == 0, F.col("id")))
    rows = sorted(now.collect(), key=lambda r: r["id"])
    sizes = []
    for _ in range(6):
        other = now.select(F.col("id").alias("j"))
        now = cut(now.join(other, F.col("id") == F.col("j")).drop("j"))
        sizes.append(_digits(now))
    assert max(sizes) <= 20
    assert sorted(now.collect(), key=lambda r: r["id"]) == rows and now.columns == ["id", "k", "n"]
    assert now.join(now.groupBy("k").agg(F.count(F.lit(1)).alias("c")), "k").agg(F.sum("c")).first()[0] == 358
    none = cut(spark.createDataFrame([], "a long, b string"))
    assert none.collect() == [] and none.dtypes == [("a", "bigint"), ("b", "string")]
