"""Session settings the operators rely on, and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Semantics, not tuning: UTC days and minutes, last duplicate JSON key wins, partition-wise overwrite.
REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.adaptive.enabled": "true",
}

# HotSpot doesn't compile methods over 8,000 bytes: fall back to split code instead of running them
# interpreted (message classification is twice as fast).
TUNING = {"spark.sql.codegen.hugeMethodLimit": "8000"}


def prepare(spark: SparkSession) -> SparkSession:
    """Set what results depend on. Cluster sizing (shuffle partitions, memory) stays the caller's."""
    for key, value in {**REQUIRED, **TUNING}.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: str = "8", **conf: str) -> SparkSession:
    """A local session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tidemark")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")  # no stack walk per column
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.parquet.compression.codec", "zstd")
    )
    for key, value in {**REQUIRED, **TUNING, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder the cluster names in `spark.checkpoint.dir`.

    Only where that is unset (tests, local runs) does it fall back to a local temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
