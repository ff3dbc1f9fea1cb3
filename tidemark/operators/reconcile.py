"""The pre-aggregate against the raw rows it came from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.times import at_ms, minute, seconds
from tidemark.operators.hours import in_range
from tidemark.operators.rollups import merge_counts, per_minute
from tidemark.operators.windows import prune_days


def settled_range(oldest_s: int, now_ms: int, settle_s: int) -> tuple[int, int]:
    """Whole minutes after the oldest row's, up to where the settle window starts."""
    return (oldest_s // 60 + 1) * 60, (now_ms // 1000 - settle_s) // 60 * 60


def mismatches(edits: DataFrame, edits_per_minute: DataFrame, from_s: int, to_s: int) -> DataFrame:
    """Minutes and languages where raw and rolled counts differ; a missing side counts as 0.

    Both sides are added into one grouping: the full outer join's answer with one shuffle of
    partial sums, and no NULLs to compare.
    """
    raw = in_range(edits, from_s, to_s).select(
        minute("event_time").alias("minute"), "lang", F.lit(1).alias("raw"), F.lit(0).alias("rolled")
    )
    rolled = (
        prune_days(edits_per_minute, from_s * 1000, to_s * 1000)
        .where((F.col("minute") >= at_ms(from_s * 1000)) & (F.col("minute") < at_ms(to_s * 1000)))
        .select("minute", "lang", F.lit(0).alias("raw"), F.col("edits").alias("rolled"))
    )
    return (
        raw.unionByName(rolled)
        .groupBy("minute", "lang")
        .agg(F.sum("raw").alias("raw"), F.sum("rolled").alias("rolled"))
        .where("raw <> rolled")
        .select(seconds("minute").alias("minute_s"), "lang", "raw", "rolled")
    )


def without_minutes(edits_per_minute: DataFrame, minutes: DataFrame) -> DataFrame:
    """Rollup rows outside the listed minutes (all languages)."""
    listed = minutes.select(F.timestamp_seconds("minute_s").alias("minute")).distinct()
    return edits_per_minute.join(listed, "minute", "left_anti")


def of_minutes(edits: DataFrame, minutes: DataFrame) -> DataFrame:
    """Raw rows of the listed minutes (all languages)."""
    listed = minutes.select(F.timestamp_seconds("minute_s").alias("m")).distinct()
    return edits.join(listed, minute("event_time") == F.col("m"), "left_semi")


def repaired(edits: DataFrame, edits_per_minute: DataFrame, minutes: DataFrame) -> DataFrame:
    """The rollup with the listed minutes counted again from raw rows."""
    kept = merge_counts(without_minutes(edits_per_minute, minutes))
    return kept.unionByName(per_minute(of_minutes(edits, minutes)))
