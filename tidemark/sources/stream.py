"""The landed event stream: one message a row, in arrival order by `position`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.times import at_ms
from tidemark.schema import LANDED

KAFKA_PARTITIONS = 1_024  # more than a topic ever has: makes offset and partition one counter


def landed_files(
    spark: SparkSession, path: str, file_format: str = "parquet", max_files: int | None = None, since_ms: int | None = None
) -> DataFrame:
    """Files a connector lands (JSON lines or Parquet). Resumes from the checkpoint; `since_ms`
    starts a fresh one part way."""
    reader = spark.readStream.schema(LANDED).format(file_format)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    rows = reader.load(path)
    return rows if since_ms is None else rows.where(F.col("received_at") >= at_ms(since_ms))


def kafka_topic(
    spark: SparkSession, servers: str, topic: str, since_ms: int | None = None, max_offsets: int = 5_000
) -> DataFrame:
    """A topic whose key is the stream id and whose value is the message."""
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("maxOffsetsPerTrigger", max_offsets)
    )
    if since_ms is not None:
        reader = reader.option("startingTimestamp", since_ms)
    return reader.load().select(
        (F.col("offset") * KAFKA_PARTITIONS + F.col("partition")).alias("position"),
        F.col("key").cast("string").alias("sse_id"),
        F.col("value").cast("string").alias("data"),
        F.col("timestamp").alias("received_at"),
    )
