"""Scheduled upkeep: fold partial rows together, delete rows, let old partitions go."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import DEFAULTS, Settings
from tidemark.operators import page_tree, rollups
from tidemark.plans.reconcile import require_quiet
from tidemark.sources.tables import Held, Tables

_MERGED = {
    "edits": lambda rows: rows.drop("token"),
    "edits_per_minute": lambda rows: rollups.with_month(rollups.merge_counts(rows)),
    "pages_per_minute": lambda rows: rollups.with_day(rollups.merge_pages(rows)),
    "pages_per_hour": lambda rows: rows.select("hour", *page_tree.MEMBER, "dt").distinct(),
    "pages_per_day": lambda rows: rows.select(*page_tree.MEMBER, "dt").distinct(),
}
_TIME = {
    "ingest_gaps": "detected_at",
    "ingest_reconnects": "at",
    "freshness_samples": "sampled_at",
    "aws_cost": "fetched_at",
    "pages_filled": "filled_at",
}


def compact(tables: Tables, name: str, value: str, now_ms: int) -> None:
    """Fold one day's (or month's) token partitions into one. Sums and sets read the same after.

    Ingest may go on meanwhile: only the tokens read are removed, and each stream's newest batch
    is left for the next time.
    """
    compact_all(tables, name, [value], now_ms)


def compact_all(tables: Tables, name: str, values: Sequence[str], now_ms: int) -> None:
    """Fold each of these days (or months) in one swap: its jobs don't grow with their number, and all are worked on at once."""
    tables.finish_replace(name)
    held = tables.hold(name, values, settled=True)
    writes = Counter(value for value, _ in held.tokens)
    held = Held(name, tuple((v, t) for v, t in held.tokens if writes[v] > 1))
    if held.tokens:
        tables.swap(held, _MERGED[name](tables.read_held(held)), f"compacted-{now_ms}")


def compact_log(tables: Tables, name: str, now_ms: int) -> None:
    """Fold a log's appends into one; ledgers keep each hour's newest record."""
    tables.finish_replace(name)
    held = tables.hold(name, settled=name == "outcomes")
    rows = tables.read_held(held)
    if name == "archive_hours":
        rows = rows.groupBy("hour").agg(
            F.max_by(F.struct("rows", "written_at"), F.struct("written_at", "rows")).alias("r")
        ).select("hour", "r.rows", "r.written_at")
    elif name == "outcomes":
        rows = rows.groupBy("outcome").agg(F.sum("n").alias("n"))
    elif name == "pages_filled":
        rows = rows.groupBy("hour").agg(F.max("filled_at").alias("filled_at"))
    tables.swap(held, rows, f"compacted-{now_ms}")


def delete_rows(tables: Tables, name: str, value: str, doomed: Column, now_ms: int, settings: Settings = DEFAULTS) -> None:
    """Rewrite one partition without the rows `doomed` is true for, of those there are now."""
    tables.finish_replace(name)
    require_quiet(tables, now_ms, settings.quiet_s)
    tables.fence(name, [value], f"deleted-{now_ms}")
    held = tables.hold(name, [value])
    kept = tables.read_held(held).where(~F.coalesce(doomed, F.lit(False)))
    tables.swap(held, kept.drop("token"), f"deleted-{now_ms}")


def _cutoff(now_ms: int, days: int) -> date:
    return datetime.fromtimestamp(now_ms // 1000, timezone.utc).date() - timedelta(days=days)


def expired_partitions(tables: Tables, name: str, now_ms: int, settings: Settings = DEFAULTS) -> list[str]:
    """Whole partitions past retention: days before the cut-off day, months before its month."""
    cutoff = _cutoff(now_ms, settings.retention_days[name])
    limit = f"{cutoff:%Y%m}" if name == "edits_per_minute" else cutoff.isoformat()
    return [value for value in tables.partitions(name) if value < limit]


def expire(tables: Tables, now_ms: int, settings: Settings = DEFAULTS) -> dict[str, list[str]]:
    """Drop expired partitions, and rewrite logs without rows past retention."""
    dropped = {}
    for name in _MERGED:
        dropped[name] = expired_partitions(tables, name, now_ms, settings)
        for value in dropped[name]:
            tables.drop_partition(name, value)
    for name, column in _TIME.items():
        cutoff = F.lit(_cutoff(now_ms, settings.retention_days[name]))
        tables.finish_replace(name)
        held = tables.hold(name)
        rows = tables.read_held(held)
        if not rows.where(F.to_date(column) < cutoff).limit(1).isEmpty():
            tables.swap(held, rows.where(F.to_date(column) >= cutoff), f"kept-{now_ms}")
            dropped[name] = ["rows"]
    return dropped
