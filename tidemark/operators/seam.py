"""The seam between what is stored and what the source sends again."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import batch_token


def ingest_tail(edits: DataFrame, limit: int, floor_seq: int | None = None) -> DataFrame:
    """The last `limit` rows by ingest order. A floor only bounds the read (row-group statistics)."""
    rows = edits if floor_seq is None else edits.where(F.col("ingest_seq") >= floor_seq)
    return rows.orderBy(F.col("ingest_seq").desc()).limit(limit).select("event_id", "sse_id", "ingest_seq")


def latest_bookmark(edits: DataFrame) -> DataFrame:
    """The stream id of the row ingested last; no row when it has none (restored rows don't).

    The highest sequence number is found first, from one narrow column; the wide ids are then read
    only from row groups that can hold it.
    """
    last = edits.agg(F.max("ingest_seq")).scalar()
    newest = edits.where(F.col("ingest_seq") >= last).agg(F.max("sse_id").alias("sse_id"))
    return newest.where("sse_id <> ''")


def first_arrivals(kept: DataFrame) -> DataFrame:
    """One row per event id, the one that arrived first.

    The row limit per id applies before the shuffle too, so one id repeated across a third of the
    batch sends a row per task, not its copies.
    """
    order = Window.partitionBy("event_id").orderBy("position")
    return kept.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")


def unseen(kept: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows whose id isn't stored yet, however many are. Which side is broadcast, if any, is decided by its measured size."""
    return kept.join(stored.select("event_id"), "event_id", "left_anti")


def numbered(kept: DataFrame, first_seq: int, first_position: int) -> DataFrame:
    """ingest_seq from the arrival counter: increasing with arrival, no sort, the same on a replay."""
    return kept.withColumn("ingest_seq", F.lit(first_seq) + F.col("position") - F.lit(first_position))


def batch_tokens(edits: DataFrame, max_rows: int) -> DataFrame:
    """One token per batch: consecutive rows of one UTC day, at most `max_rows` of them.

    Batches are runs of the ingest sequence, so a group never holds more than `max_rows` ids.
    """
    batch = F.expr(f"ingest_seq div {max_rows}")
    in_order = F.transform(
        F.array_sort(F.collect_list(F.struct("ingest_seq", "event_id"))), lambda r: r["event_id"]
    )
    return (
        edits.groupBy(F.to_date("event_time").alias("day"), batch.alias("batch"))
        .agg(F.count(F.lit(1)).alias("rows"), batch_token(in_order).alias("token"))
    )
