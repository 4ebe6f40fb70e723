"""Session construction and the shared folder for written tables."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark import SparkConf
from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Arrow batches feed the scoring kernel; keep them well inside task memory
    # for wide vectors (2048 x 3072 float32 = 25 MB).
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2048",
    "spark.ui.enabled": "false",
    # long-running sessions: keep little per-query history in the driver
    "spark.sql.ui.retainedExecutions": "20",
    "spark.ui.retainedJobs": "50",
    "spark.ui.retainedStages": "50",
    # index tables are checkpoints: remove their files once unreferenced
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app: str = "filtra", extra: dict | None = None) -> SparkSession:
    """A session with this package's defaults.

    Master and partition count are the submitter's; only where no master is
    configured at all does a local session with few partitions start.
    """
    if master is None and SparkConf().get("spark.master", None) is None:
        master = "local[*]"
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            builder = builder.config("spark.driver.memory", os.environ.get("FILTRA_DRIVER_MEM", "16g"))
            shuffle_partitions = shuffle_partitions or 8
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in {**DEFAULT_CONF, **(extra or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder on shared storage for checkpoints and written tables.

    On a cluster this is whatever ``spark.checkpoint.dir`` names (required
    there). Only a local-mode session without one (tests) gets a fresh local
    folder.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d
    base = sc.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder on shared storage")
        base = tempfile.mkdtemp(prefix="filtra-ckpt-")  # local mode only
    sc.setCheckpointDir(base)
    return sc.getCheckpointDir() or base


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique path under the shared folder."""
    root = shared_dir(spark).rstrip("/")
    return f"{root}/{name}-{uuid.uuid4().hex[:12]}"


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per Spark context.

    A submitter may also pass it with ``--py-files``; the copy sent here is then unused.
    """
    sc = spark.sparkContext
    if getattr(sc, "_filtra_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="filtra-py-"), "filtra_package.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("filtra", os.path.relpath(path, package)))
    sc.addPyFile(target)
    sc._filtra_shipped = True
