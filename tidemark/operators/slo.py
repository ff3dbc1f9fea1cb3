"""Freshness objective: the share of this month's minutes whose newest event was recent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.ratios import rounded
from tidemark.functions.times import at_ms, day_start_s, days_in_month, iso, minute, month_start, ms, seconds


def first_sample(samples: DataFrame) -> DataFrame:
    return samples.agg(ms(F.min("sampled_at")).alias("first_ms"), F.count(F.lit(1)).alias("n"))


def slo_window(first: DataFrame, now_ms: int) -> DataFrame:
    """This month's whole minutes, from the first fully measured one to the current one (excluded).

    One row: start, end, month start (unix seconds), days in the month, minutes, whether measuring
    began before the month did. Start and end are NULL before the first sample.
    """
    now = at_ms(now_ms)
    end = F.lit(now_ms // 60_000 * 60).cast("bigint")
    month_s = day_start_s(month_start(now))
    first_whole = (F.ceil(F.col("first_ms") / 60_000) * 60).cast("bigint")
    start = F.when(F.col("first_ms").isNotNull(), F.least(F.greatest(month_s, first_whole), end))
    return first.select(
        start.alias("start_s"),
        F.when(start.isNotNull(), end).alias("end_s"),
        month_s.alias("month_s"),
        days_in_month(now).alias("month_days"),
    ).withColumns(
        {
            "minutes": F.expr("(end_s - start_s) div 60"),
            "full_window": F.coalesce(F.col("start_s") <= F.col("month_s"), F.lit(False)),
        }
    )


def freshness(samples: DataFrame, threshold_s: float, start_s: int | Column, end_s: int | Column) -> DataFrame:
    """Minutes sampled and minutes fresh in `[start, end)`: fresh only if every sample was under
    the limit; no age (an empty table) is stale."""
    start_s, end_s = (F.lit(x) if isinstance(x, int) else x for x in (start_s, end_s))
    under = F.coalesce(F.col("age_s") < float(threshold_s), F.lit(False))
    return (
        samples.where((F.col("minute") >= F.timestamp_seconds(start_s)) & (F.col("minute") < F.timestamp_seconds(end_s)))
        .groupBy("minute")
        .agg(F.bool_and(under).alias("fresh"))
        .agg(F.count(F.lit(1)).alias("sampled"), F.count_if("fresh").alias("fresh"))
    )


def budget_minutes(days: Column, target: float) -> Column:
    """Minutes the whole month may miss."""
    return F.bround(days * 1440 * F.lit(1 - target), 0).cast("bigint")


def slo_report(samples: DataFrame, now_ms: int, target: float, threshold_s: float) -> DataFrame:
    """One row: the month's minutes as fresh, stale or unmeasured, the ratio and the error budget."""
    win = slo_window(first_sample(samples), now_ms)
    counts = freshness(samples, threshold_s, win.select("start_s").scalar(), win.select("end_s").scalar())
    whole = win.select(F.struct("*").alias("w")).scalar()
    return summarise(counts.select("sampled", "fresh", whole.alias("w")), target, threshold_s)


def summarise(counted: DataFrame, target: float, threshold_s: float) -> DataFrame:
    """`sampled, fresh, w` (an slo_window row as a struct) -> the report's columns.

    Counts are clamped to the window, so stray samples can't push the ratio over 1.
    """
    minutes = F.coalesce(F.col("w.minutes"), F.lit(0))
    sampled = F.least(F.col("sampled"), minutes)
    fresh = F.least(F.col("fresh"), sampled)
    ratio = F.try_divide(fresh.cast("double"), minutes.cast("double"))
    return counted.select(
        F.lit(float(target)).alias("target"),
        F.lit(float(threshold_s)).alias("threshold_s"),
        F.date_format(F.timestamp_seconds("w.month_s"), "yyyy-MM").alias("month"),
        F.col("w.month_days").alias("window_days"),
        iso(F.timestamp_seconds("w.start_s")).alias("from"),
        iso(F.timestamp_seconds("w.end_s")).alias("to"),
        minutes.alias("minutes"),
        fresh.alias("fresh"),
        (sampled - fresh).alias("stale"),
        (minutes - sampled).alias("unmeasured"),
        rounded(ratio, 6).alias("ratio"),
        (ratio >= float(target)).alias("met"),
        budget_minutes(F.col("w.month_days"), target).alias("budget_minutes"),
        (minutes - fresh).alias("budget_used"),
        F.col("w.full_window").alias("full_window"),
    )


def freshness_sample(edits: DataFrame, now_ms: int) -> DataFrame:
    """One sample: the age of the newest event now, NULL while there is none."""
    now = at_ms(now_ms)
    age = (F.lit(now_ms) - ms(F.max("event_time"))) / 1000
    return edits.agg(age.alias("age_s")).select(
        minute(now).alias("minute"), now.alias("sampled_at"), F.col("age_s").cast("double").alias("age_s")
    )
