"""Judgements the reports publish, as CASE expressions over epoch-millisecond columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.times import at_ms


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def ingest_state(newest_ms: Column | str, stored_ms: Column | str, now_ms: int, stale_after_s: float) -> Column:
    """live while the newest event is recent; catching_up while old events are still being stored."""
    newest, stored = _col(newest_ms), _col(stored_ms)
    limit = float(stale_after_s) * 1000
    return (
        F.when(newest.isNull() | stored.isNull(), "empty")
        .when(F.lit(now_ms) - newest <= limit, "live")
        .when(F.lit(now_ms) - stored <= limit, "catching_up")
        .otherwise("paused")
    )


def snapshot_status(newest_ms: Column | str, now_ms: int, stale_after_s: float) -> Column:
    newest = _col(newest_ms)
    return (
        F.when(newest.isNull(), "empty")
        .when(F.greatest(F.lit(0), F.lit(now_ms) - newest) <= float(stale_after_s) * 1000, "live")
        .otherwise("stale")
    )


def cost_check(fetched_ms: Column | str, ok: Column | str, now_ms: int) -> Column:
    """How today's (UTC) attempt went; pending while there is none."""
    fetched, ok = _col(fetched_ms), _col(ok)
    today = F.to_date(F.timestamp_millis(fetched)) == F.to_date(at_ms(now_ms))
    return F.when(~F.coalesce(today, F.lit(False)), "pending").when(ok, "ok").otherwise("failed")


def gap_duration_s(gap_from: Column | str, gap_to: Column | str) -> Column:
    """Whole seconds, half-even, never negative."""
    millis = F.unix_millis(_col(gap_to)) - F.unix_millis(_col(gap_from))
    return F.greatest(F.lit(0), F.bround(millis / 1000, 0)).cast("bigint")
