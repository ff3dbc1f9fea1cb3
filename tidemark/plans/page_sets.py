"""Keep the per-minute page sets complete for the days they are kept."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import RETENTION_DAYS
from tidemark.functions.times import at_ms, day_start_of, hour
from tidemark.operators.hours import filled_hours, missing_hours
from tidemark.operators import page_tree
from tidemark.operators.rollups import pages_per_minute, with_day
from tidemark.schema import ARCHIVE_PAGE_COLUMNS
from tidemark.sources.archive import days_of, existing_hours, read_archive
from tidemark.sources.tables import Tables


def add_pages(tables: Tables, edits: DataFrame, token: str) -> None:
    """Add the pages of these edits (or minute sets) to their minutes, hours and days. Sets only add: a page already there changes nothing.

    Minutes come last, so a minute's page is in its hour and day, or will be when the write that was cut off is done again.
    """
    minutes = tables.keep(f"pages-{token}", pages_per_minute(edits))  # edits are read once; hours and days come from their members
    tables.write_once("pages_per_day", page_tree.per_day(minutes), token)
    tables.write_once("pages_per_hour", page_tree.per_hour(minutes).withColumn("dt", F.to_date("hour")), token)
    tables.write_once("pages_per_minute", with_day(minutes), token)
    tables.drop_kept(f"pages-{token}")


def complete_tree(tables: Tables) -> int:
    """Build hours and days of writes that have minute sets only (written before there was a tree). Returns how many writes."""
    days = tables.partitions("pages_per_minute")
    known = set(tables.hold("pages_per_day", days).tokens)
    lacking = sorted({t for v, t in tables.hold("pages_per_minute", days).tokens if (v, t) not in known})
    for token in lacking:
        minutes = tables.read_token("pages_per_minute", token)
        tables.write_once("pages_per_hour", page_tree.per_hour(minutes).withColumn("dt", F.to_date("hour")), token)
        tables.write_once("pages_per_day", page_tree.per_day(minutes), token)
    return len(lacking)


def of_hours(edits: DataFrame, hours: DataFrame) -> DataFrame:
    """Rows of the listed hours (a planner's list, bounded by retention)."""
    listed = hours.select(F.timestamp_seconds("hour_s").alias("h"))
    return edits.join(F.broadcast(listed), hour("event_time") == F.col("h"), "left_semi")


def mark_filled(tables: Tables, hours: DataFrame, now_ms: int, token: str) -> None:
    rows = hours.select(F.timestamp_seconds("hour_s").alias("hour"), at_ms(now_ms).alias("filled_at"))
    tables.write_once("pages_filled", rows, token)


def _fill(tables: Tables, edits: DataFrame, hours: DataFrame, now_ms: int, token: str) -> None:
    """Pages first, the record after: an interrupted fill is simply done again."""
    add_pages(tables, of_hours(edits, hours), f"fill-{token}")
    mark_filled(tables, hours, now_ms, f"fill-{token}")


def fill_from_raw(tables: Tables, edits: DataFrame, hours: DataFrame, now_ms: int, token: str) -> None:
    _fill(tables, edits, hours, now_ms, f"raw-{token}")


def fill_from_archive(tables: Tables, base: str, hours: DataFrame, now_ms: int, token: str) -> None:
    days = [r["d"] for r in hours.select(F.to_date(F.timestamp_seconds("hour_s")).alias("d")).distinct().collect()]
    archived = read_archive(tables.spark, base, ARCHIVE_PAGE_COLUMNS, days)
    _fill(tables, archived, hours, now_ms, f"file-{token}")


def unfilled_hours(tables: Tables, base: str, now_ms: int) -> DataFrame:
    """Archived hours the page sets are still kept for, with no finished fill."""
    kept_days = timedelta(days=RETENTION_DAYS["pages_per_minute"])
    first = (datetime.fromtimestamp(now_ms // 1000, timezone.utc) - kept_days).date()
    archived = existing_hours(tables.spark, base, days_of(day_start_of(first), now_ms // 1000 + 1)).where(F.col("hour_s") >= day_start_of(first))
    return missing_hours(archived, filled_hours(tables.read("pages_filled")))


def fill_missing(tables: Tables, base: str, now_ms: int) -> list[int]:
    """Fill every archived hour without a finished fill; returns the hours filled, oldest first."""
    hours = [r["hour_s"] for r in unfilled_hours(tables, base, now_ms).orderBy("hour_s").collect()]
    if hours:
        listed = tables.spark.createDataFrame([(h,) for h in hours], "hour_s BIGINT")
        fill_from_archive(tables, base, listed, now_ms, f"missing-{now_ms}")
    return hours
