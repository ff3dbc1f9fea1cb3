"""Rebuild the per-minute pre-aggregate of whole UTC days from the archive."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import functions as F

from tidemark.config import DAY_S, REBUILD_MAX_DAYS, RETENTION_DAYS
from tidemark.functions.times import at_s, day_start_of, hour
from tidemark.operators import hours, rollups
from tidemark.plans import page_sets
from tidemark.plans.reconcile import Mark, require_quiet, require_unchanged
from tidemark.schema import ARCHIVE_ROLLUP_COLUMNS
from tidemark.sources.archive import existing_hours, read_archive
from tidemark.sources.tables import Tables


class ArchiveIncomplete(RuntimeError):
    """Hours have no file, or a file doesn't hold what it should."""


def _require_none(found, what: str) -> None:
    """Raise with a count and the first hour if `found` (hour_s rows) isn't empty."""
    row = found.agg(F.count(F.lit(1)).alias("n"), F.timestamp_seconds(F.min("hour_s")).cast("string").alias("first")).first()
    if row["n"]:
        raise ArchiveIncomplete(f"{row['n']} {what}, first {row['first']}")


def rebuild(
    tables: Tables,
    base: str,
    first: date,
    end: date,
    now_ms: int,
    allow_missing: bool = False,
    quiet_s: int = 30,
    mark: Mark | None = None,
) -> int:
    """Rebuild days `[first, end)`; returns pre-aggregate rows in the range afterwards.

    Everything is staged and checked against the files' recorded counts before anything is
    replaced. Hours without a file keep what they have.
    """
    if not 0 < (end - first).days <= REBUILD_MAX_DAYS:
        raise ValueError(f"the range must cover 1 to {REBUILD_MAX_DAYS} days")
    spark = tables.spark
    tables.finish_replace("edits_per_minute")
    from_s, to_s = day_start_of(first), day_start_of(end)
    days = [first + timedelta(days=i) for i in range((end - first).days)]

    spine = hours.hour_spine(spark, from_s, to_s)
    archived = spine.join(F.broadcast(existing_hours(spark, base, days)), "hour_s", "left_semi")
    archived = tables.keep("rebuild_hours", archived)
    if not allow_missing:
        _require_none(hours.missing_hours(spine, archived), "hour(s) have no file (allow_missing rebuilds the rest)")

    source = read_archive(spark, base, ARCHIVE_ROLLUP_COLUMNS, days)
    in_range = (F.col("event_time") >= at_s(from_s)) & (F.col("event_time") < at_s(to_s))
    staged = tables.keep("rebuild_staged", rollups.per_minute(source.where(in_range)))
    held = rollups.staged_hours(staged)
    _require_none(hours.missing_hours(archived, held), "file(s) produced no rows")
    recorded = hours.recorded_counts(tables.read("archive_hours"), from_s, to_s)
    _require_none(hours.short_hours(recorded, held), "file(s) don't hold the rows recorded for them")

    if mark is None:
        mark = require_quiet(tables, now_ms, quiet_s)
    else:
        require_unchanged(tables, mark)
    months = sorted({d.year * 100 + d.month for d in days})
    tables.fence("edits_per_minute", months, f"rebuild-{now_ms}")
    held = tables.hold("edits_per_minute", months)
    live = tables.read_held(held)
    rebuilt = F.broadcast(archived.select(F.timestamp_seconds("hour_s").alias("h")))
    untouched = live.join(rebuilt, hour("minute") == F.col("h"), "left_anti")
    whole = staged.unionByName(rollups.merge_counts(untouched))
    whole = tables.keep("rebuild_whole", whole)
    tables.swap(held, rollups.with_month(whole), f"rebuild-{now_ms}")
    require_unchanged(tables, mark)

    within = (F.col("minute") >= at_s(from_s)) & (F.col("minute") < at_s(to_s))
    rows = tables.read("edits_per_minute").where(F.col("month").isin(*months)).where(within).count()
    expected = whole.where(within).count()
    kept_from = now_ms // 1000 - RETENTION_DAYS["pages_per_minute"] * DAY_S
    recent = archived.where(F.col("hour_s") >= kept_from)
    if not recent.isEmpty():
        page_sets.fill_from_archive(tables, base, recent, now_ms, f"rebuild-{now_ms}-{from_s}")
    if rows != expected:
        raise ArchiveIncomplete(f"{rows} rows in the range after the swap, {expected} were staged")
    return rows


