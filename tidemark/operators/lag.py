"""How long events took to be stored, and how often the source dropped the connection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import LAG_WINDOW_S, RECONNECT_WINDOW_S
from tidemark.functions.times import at_ms, lag_ms
from tidemark.operators.quantiles import exact_quantiles
from tidemark.operators.windows import recent

P50_P95 = {"p50_ms": 0.5, "p95_ms": 0.95}


def _lags(edits: DataFrame) -> DataFrame:
    return edits.select(lag_ms("event_time", "ingested_at").alias("lag"))


def ingest_lag(edits: DataFrame, to_ms: int) -> DataFrame:
    """p50 and p95 over the newest event-time minute."""
    return exact_quantiles(_lags(recent(edits, to_ms, 60)), "lag", P50_P95)


def stored_lag(edits: DataFrame, now_ms: int, window_s: int = LAG_WINDOW_S) -> DataFrame:
    """p50 and p95 over rows stored in the last hour, late and replayed ones included."""
    stored = edits.where(F.col("ingested_at") > at_ms(now_ms - window_s * 1000))
    return exact_quantiles(_lags(stored), "lag", P50_P95)


def reconnects_by_reason(reconnects: DataFrame, now_ms: int, window_s: int = RECONNECT_WINDOW_S) -> DataFrame:
    return (
        reconnects.where(F.col("at") > at_ms(now_ms - window_s * 1000))
        .groupBy("reason")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.col("n").desc(), "reason")
    )
