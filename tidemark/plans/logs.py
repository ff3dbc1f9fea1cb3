"""Small event logs: gaps, reconnects, freshness samples, cost attempts. Each append is keyed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.times import at_ms
from tidemark.operators.costs import parse_answers
from tidemark.operators.slo import freshness_sample
from tidemark.operators.windows import prune_days
from tidemark.sources.tables import Tables


def record_gaps(tables: Tables, gaps: DataFrame, token: str) -> None:
    """Append gap rows (see `plans.resume.gap_row`)."""
    tables.write_once("ingest_gaps", gaps, f"gap-{token}")


def record_reconnects(tables: Tables, landed: DataFrame, token: str) -> None:
    """Append a sealed batch of `at, reason` rows; the same token again is a no-op."""
    tables.write_once("ingest_reconnects", landed, f"rc-{token}")


def record_sample(tables: Tables, now_ms: int) -> None:
    """Sample the newest event's age, once per minute however often it runs in it."""
    edits, newest = tables.read("edits"), tables.watermark_ms()
    if newest is not None:
        edits = prune_days(edits, newest, newest)
    tables.write_once("freshness_samples", freshness_sample(edits, now_ms), f"m-{now_ms // 60_000}")


def record_costs(tables: Tables, answers: DataFrame, token: str) -> None:
    """Append landed cost answers as attempts, failed ones included."""
    tables.write_once("aws_cost", parse_answers(answers), f"cost-{token}")


def record_archived(tables: Tables, hours: DataFrame, now_ms: int, token: str) -> None:
    """Record what hours' files hold (`hour_s, rows`)."""
    rows = hours.select(F.timestamp_seconds("hour_s").alias("hour"), "rows", at_ms(now_ms).alias("written_at"))
    tables.write_once("archive_hours", rows, token)
