"""Per-minute pre-aggregates: partial sums, and page sets stored as distinct rows.

Partials of a minute may sit in many rows; every reader sums (or takes distinct), so adding a
batch's partials, merging them later, or never merging them gives the same answer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.times import hour, minute, seconds, yyyymm

PAGE = ("minute", "lang", "namespace", "title")


def per_minute(edits: DataFrame) -> DataFrame:
    """Edits and bot edits per minute and language."""
    return edits.groupBy(minute("event_time").alias("minute"), "lang").agg(
        F.count(F.lit(1)).alias("edits"), F.count_if(F.col("is_bot")).alias("bot_edits")
    )


def pages_per_minute(edits: DataFrame) -> DataFrame:
    """The exact set of pages edited per minute and language, one row a member.

    A row a member, not an array a minute: a minute holding a third of all edits stays spread out.
    """
    return edits.select(minute("event_time").alias("minute"), "lang", "namespace", "title").distinct()


def merge_counts(partials: DataFrame) -> DataFrame:
    return partials.groupBy("minute", "lang").agg(
        F.sum("edits").alias("edits"), F.sum("bot_edits").alias("bot_edits")
    )


def merge_pages(*sets: DataFrame) -> DataFrame:
    """Set union: adding the same pages twice changes nothing."""
    merged = sets[0].select(*PAGE)
    for more in sets[1:]:
        merged = merged.unionByName(more.select(*PAGE))
    return merged.distinct()


def with_month(per_minute_rows: DataFrame) -> DataFrame:
    return per_minute_rows.withColumn("month", yyyymm("minute"))


def with_day(page_rows: DataFrame) -> DataFrame:
    return page_rows.withColumn("dt", F.to_date("minute"))


def pages_per_hour(pages: DataFrame) -> DataFrame:
    """Distinct pages per hour and language, merging the minute sets."""
    return pages.groupBy(seconds(hour("minute")).alias("hour_s"), "lang").agg(
        F.count_distinct("namespace", "title").alias("pages")
    )


def staged_hours(staged: DataFrame) -> DataFrame:
    """Rollup rows and edits per hour of a staged rebuild."""
    return staged.groupBy(seconds(hour("minute")).alias("hour_s")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("edits").alias("edits")
    )


def newest_minute(edits_per_minute: DataFrame) -> DataFrame:
    return edits_per_minute.agg(seconds(F.max("minute")).alias("newest_s"), F.count(F.lit(1)).alias("n"))


def minute_coverage(edits: DataFrame) -> DataFrame:
    """Minutes with an edit, against the minutes from the first to the last."""
    m = minute("event_time")
    return edits.agg(
        F.count_distinct(m).alias("present"),
        (F.expr("(unix_seconds(max(date_trunc('minute', event_time))) - "
                "unix_seconds(min(date_trunc('minute', event_time)))) div 60 + 1")).alias("span"),
    )
