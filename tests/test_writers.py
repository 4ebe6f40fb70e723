"""How many tasks write a layout follows the bytes of its rows, not only their number."""

import glob

from filtra.plans import catalog
from filtra.sources import sinks
from testdirs import SF_SMALL


def wide(spark, n=400, chars=5000):
    from pyspark.sql import functions as F
    return spark.range(n).select("id", F.lit("kb_00").alias("kbId"), F.lit("doc_1").alias("documentId"),
                                 F.repeat(F.col("id").cast("string"), chars).alias("content"),
                                 *[F.lit("v").alias(f) for f in ("study", "site", "patient", "visit")])


def test_wide_rows_get_more_writers(spark, tmp_path, monkeypatch):
    df = wide(spark)
    assert sinks.writers(df) == 1
    monkeypatch.setattr(sinks, "BYTES_PER_WRITER", 500_000)
    assert sinks.writers(df) >= 8 and sinks.writers(df, 10_000.0) == 8 and sinks.writers(df.limit(0)) == 1
    for name, put in (("clustered", sinks.write_clustered), ("kb", sinks.write_corpus)):
        put(df, str(tmp_path / name))
        assert len(glob.glob(f"{tmp_path}/{name}/kbId=kb_00/*.parquet")) >= 6
        assert sorted(r[0] for r in spark.read.parquet(str(tmp_path / name)).select("id").collect()) == list(range(400))


def test_repeated_ids_land_in_as_many_files_as_their_bytes_need(spark, monkeypatch):
    from filtra.streaming import ingest
    seen = []
    land = catalog._land
    monkeypatch.setattr(catalog, "_land", lambda *a, **b: seen.append(land(*a, **b)) or seen[-1])
    monkeypatch.setattr(ingest, "stream_ingest", lambda *a, **b: None)
    monkeypatch.setattr(sinks, "BYTES_PER_WRITER", 1_000)
    catalog._ingested(spark, SF_SMALL)
    landed, held = spark.read.parquet(seen[0]), catalog.chunks_view(spark, SF_SMALL)
    again = held.filter("id % 10 = 0")
    assert landed.count() == held.count() + again.count()
    # all repeats were one file, written by one task
    files = landed.select("id", "_metadata.file_path").groupBy("file_path").agg({"id": "collect_set"}).collect()
    assert len([f for f in files if all(i % 10 == 0 for i in f[1])]) >= 2
