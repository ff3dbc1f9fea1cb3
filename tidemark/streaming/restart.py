"""Start ingest from a fresh checkpoint where the stored rows end.

The resume row (see `plans.resume`) is decided once a checkpoint and kept beside its offsets, so that a run that is cut
off goes on from the same place. The gap it leaves is recorded under a token made of its first minute: deciding again
before anything was stored replaces that row and doesn't add one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.config import DEFAULTS, Settings
from tidemark.plans import logs, resume
from tidemark.sources.stream import landed_files
from tidemark.sources.tables import Tables
from tidemark.streaming.ingest import Ingest


def pick_up(tables: Tables, checkpoint: str, now_ms: int, settings: Settings = DEFAULTS) -> Row:
    """The resume row this checkpoint began with; decided from the ledger, and its gap recorded, if it is new."""
    noted = f"{checkpoint}/pickup"
    tables.finish_replace("edits")
    tables.complete_ledger()
    state = resume.resume_state(None, tables.read("edits_per_minute"), now_ms, settings, tables.ledger())
    if tables.files.exists(f"{noted}/_SUCCESS"):
        return tables.spark.read.schema(state.schema).parquet(noted).first()
    row = state.first()
    decided = tables.spark.createDataFrame([row], state.schema)
    if row["gap_from_ms"] is not None:
        logs.record_gaps(tables, resume.gap_row(decided, now_ms), f"{row['start']}-{row['gap_from_ms']}")
    decided.write.mode("overwrite").parquet(noted)
    return row


def after_bookmark(messages: DataFrame, landed: DataFrame, bookmark: str) -> DataFrame:
    """Messages from the one with this stream id on: it comes once more and is known. All, if it isn't among those landed."""
    first = landed.where(F.col("sse_id") == bookmark).agg(F.min("position").alias("p")).first()["p"]
    # a message without a position stays: ingest refuses it by name
    return messages if first is None else messages.where((F.col("position") >= first) | F.col("position").isNull())


def resume_ingest(
    tables: Tables,
    landed: str,
    checkpoint: str,
    now_ms: int,
    settings: Settings = DEFAULTS,
    file_format: str = "parquet",
    max_files: int | None = None,
    available_now: bool = False,
) -> StreamingQuery:
    """Ingest what a connector lands, from where the store ends: at the bookmark, or at the resume row's time and floor."""
    row = pick_up(tables, checkpoint, now_ms, settings)
    messages = landed_files(tables.spark, landed, file_format, max_files, row["since_ms"])
    if row["bookmark"] is not None:
        known = tables.spark.read.schema(messages.schema).format(file_format).load(landed)
        messages = after_bookmark(messages, known, row["bookmark"])
    return Ingest(tables, settings, row["floor_ms"]).start(messages, checkpoint, available_now)
