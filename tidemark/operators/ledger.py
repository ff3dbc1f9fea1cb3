"""What each write of `edits` holds, one row a day and token: answers that need no raw row.

A summary is kept with its rows and folded with them, so the ledger always adds up to the table. It has
a row for each token partition, not for each edit; `minutes` lists at most the 1,440 of its day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.times import at_ms, ms, seconds


def summaries(edits: DataFrame) -> DataFrame:
    """One row a (day, token) of stored edits: extent in time, arrival and sequence, the last row's stream id, event minutes."""
    return edits.groupBy("dt", "token").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("event_time").alias("first_time"),
        F.max("event_time").alias("last_time"),
        F.min("ingested_at").alias("first_stored"),
        F.max("ingested_at").alias("last_stored"),
        F.min("ingest_seq").alias("first_seq"),
        F.max("ingest_seq").alias("last_seq"),
        F.max(F.struct("ingest_seq", "sse_id"))["sse_id"].alias("sse_id"),
        F.sort_array(F.collect_set(F.expr("unix_seconds(event_time) div 60"))).alias("minutes"),
    )


def extent(ledger: DataFrame) -> DataFrame:
    """One row: oldest and newest event, last stored time, highest sequence number, rows; NULLs and 0 for an empty table."""
    return ledger.agg(
        ms(F.min("first_time")).alias("oldest_ms"),
        ms(F.max("last_time")).alias("newest_ms"),
        seconds(F.max("last_time")).alias("newest_s"),
        ms(F.max("last_stored")).alias("stored_ms"),
        F.max("last_seq").alias("seq"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("n"),
    )


def raw_span(ledger: DataFrame) -> DataFrame:
    return extent(ledger).select("oldest_ms", "newest_ms", "newest_s", F.col("stored_ms").alias("ingested_ms"), "n")


def head(ledger: DataFrame) -> DataFrame:
    """Newest event, last stored row, row count."""
    return extent(ledger).select("newest_ms", "stored_ms", "n")


def max_ingest_seq(ledger: DataFrame) -> DataFrame:
    return extent(ledger).select("seq")


def ingest_mark(ledger: DataFrame) -> DataFrame:
    return extent(ledger).select(F.coalesce("seq", F.lit(0)).alias("seq"), F.coalesce("stored_ms", F.lit(0)).alias("last_ms"), "n")


def latest_bookmark(ledger: DataFrame) -> DataFrame:
    """The stream id of the row ingested last; no row when it has none (restored rows don't)."""
    last = ledger.agg(F.max(F.struct("last_seq", "sse_id"))["sse_id"].alias("sse_id"))
    return last.where("sse_id <> ''")


def stored_since(ledger: DataFrame, since_ms: int) -> DataFrame:
    """(dt, token) of the writes that may hold rows stored after a time."""
    return ledger.where(F.col("last_stored") > at_ms(since_ms)).select("dt", "token")


def sharing_minutes(ledger: DataFrame, minutes: DataFrame) -> DataFrame:
    """(dt, token) of the writes that hold events of the listed minutes (`m`, unix minutes)."""
    held = ledger.select("dt", "token", F.explode("minutes").alias("m"))
    return held.join(minutes.select("m"), "m", "left_semi").select("dt", "token").distinct()
