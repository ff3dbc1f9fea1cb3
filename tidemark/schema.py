"""Column-level schemas. Every read names its schema; nothing is inferred."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DateType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructType,
    TimestampType,
)

_TYPES = {
    "STRING": StringType(),
    "TIMESTAMP": TimestampType(),
    "DATE": DateType(),
    "BOOLEAN": BooleanType(),
    "INT": IntegerType(),
    "BIGINT": LongType(),
    "DOUBLE": DoubleType(),
    "BIGINTS": ArrayType(LongType()),
}


def _ddl(text: str) -> StructType:
    """`name TYPE, ...` as a StructType; usable before a session exists."""
    schema = StructType()
    for column in text.split(","):
        name, kind = column.split()
        schema = schema.add(name, _TYPES[kind])
    return schema


# What a connector lands: one stream message a row. `position` is the connector's arrival counter.
LANDED = _ddl("position BIGINT, sse_id STRING, data STRING, received_at TIMESTAMP")

EDIT_COLUMNS = (
    "event_id STRING, event_time TIMESTAMP, ingested_at TIMESTAMP, wiki STRING, lang STRING, "
    "type STRING, namespace INT, title STRING, is_bot BOOLEAN"
)
EDITS = _ddl(f"{EDIT_COLUMNS}, sse_id STRING, ingest_seq BIGINT, dt DATE, token STRING")
EDITS_PER_MINUTE = _ddl(
    "minute TIMESTAMP, lang STRING, edits BIGINT, bot_edits BIGINT, month INT, token STRING"
)
PAGES_PER_MINUTE = _ddl(
    "minute TIMESTAMP, lang STRING, namespace INT, title STRING, dt DATE, token STRING"
)
PAGES_PER_HOUR = _ddl("hour TIMESTAMP, lang STRING, namespace INT, title STRING, dt DATE, token STRING")
PAGES_PER_DAY = _ddl("lang STRING, namespace INT, title STRING, dt DATE, token STRING")

# What each write of edits holds (operators/ledger.py); written with it, folded with it.
EDIT_BATCHES = _ddl(
    "rows BIGINT, first_time TIMESTAMP, last_time TIMESTAMP, first_stored TIMESTAMP, last_stored TIMESTAMP, "
    "first_seq BIGINT, last_seq BIGINT, sse_id STRING, minutes BIGINTS, dt DATE, token STRING"
)
# Batches that a rewrite found and whose replay has to be checked against it.
FENCES = _ddl("name STRING, part_value STRING, batch STRING, token STRING")
OUTCOMES = _ddl("outcome STRING, n BIGINT, token STRING")

ARCHIVE = _ddl(f"{EDIT_COLUMNS}, dt DATE, hour STRING")
ARCHIVE_ROLLUP_COLUMNS = _ddl("event_time TIMESTAMP, lang STRING, is_bot BOOLEAN, dt DATE, hour STRING")
ARCHIVE_PAGE_COLUMNS = _ddl(
    "event_time TIMESTAMP, lang STRING, namespace INT, title STRING, dt DATE, hour STRING"
)

ARCHIVE_HOURS = _ddl("hour TIMESTAMP, rows BIGINT, written_at TIMESTAMP, token STRING")
PAGES_FILLED = _ddl("hour TIMESTAMP, filled_at TIMESTAMP, token STRING")
INGEST_GAPS = _ddl(
    "detected_at TIMESTAMP, gap_from TIMESTAMP, gap_to TIMESTAMP, reason STRING, token STRING"
)
INGEST_RECONNECTS = _ddl("at TIMESTAMP, reason STRING, token STRING")
FRESHNESS_SAMPLES = _ddl("minute TIMESTAMP, sampled_at TIMESTAMP, age_s DOUBLE, token STRING")
AWS_COST = _ddl(
    "fetched_at TIMESTAMP, ok BOOLEAN, period_start DATE, period_end DATE, amount STRING, "
    "currency STRING, estimated BOOLEAN, error STRING, token STRING"
)

# Table name -> (schema, partition columns). The last partition column is always the write token.
TABLES = {
    "edits": (EDITS, ("dt", "token")),
    "edits_per_minute": (EDITS_PER_MINUTE, ("month", "token")),
    "pages_per_minute": (PAGES_PER_MINUTE, ("dt", "token")),
    "pages_per_hour": (PAGES_PER_HOUR, ("dt", "token")),
    "pages_per_day": (PAGES_PER_DAY, ("dt", "token")),
    "edit_batches": (EDIT_BATCHES, ("dt", "token")),
    "fences": (FENCES, ("token",)),
    "outcomes": (OUTCOMES, ("token",)),
    "archive_hours": (ARCHIVE_HOURS, ("token",)),
    "pages_filled": (PAGES_FILLED, ("token",)),
    "ingest_gaps": (INGEST_GAPS, ("token",)),
    "ingest_reconnects": (INGEST_RECONNECTS, ("token",)),
    "freshness_samples": (FRESHNESS_SAMPLES, ("token",)),
    "aws_cost": (AWS_COST, ("token",)),
}
