"""Windows that end at the newest event, and what is counted in them."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.times import at_ms, ms

MINUTE_MS = 60_000


def newest(edits: DataFrame) -> DataFrame:
    """Newest event time and row count; `newest_ms` is NULL for an empty table."""
    return edits.agg(ms(F.max("event_time")).alias("newest_ms"), F.count(F.lit(1)).alias("n"))


def newest_ms(edits: DataFrame) -> int | None:
    """The watermark every window of one report ends at: one row, read once by the driver."""
    return edits.agg(ms(F.max("event_time")).alias("newest_ms")).first()["newest_ms"]


def floor_minute_ms(to_ms: int) -> int:
    return to_ms // MINUTE_MS * MINUTE_MS


def _day(value_ms: int) -> Column:
    return F.lit(datetime.fromtimestamp(value_ms // 1000, timezone.utc).date())


def prune_days(rows: DataFrame, from_ms: int, to_ms: int) -> DataFrame:
    """Restrict a day-partitioned table to the days a time range touches."""
    if "dt" in rows.columns:
        return rows.where(F.col("dt").between(_day(from_ms), _day(to_ms)))
    if "month" in rows.columns:
        lo, hi = (datetime.fromtimestamp(v // 1000, timezone.utc) for v in (from_ms, to_ms))
        return rows.where(F.col("month").between(lo.year * 100 + lo.month, hi.year * 100 + hi.month))
    return rows


def recent(edits: DataFrame, to_ms: int, window_s: int, langs: Sequence[str] | None = None) -> DataFrame:
    """Raw rows in `(to - window, to]`, optionally of some languages."""
    from_ms = to_ms - window_s * 1000
    rows = prune_days(edits, from_ms, to_ms)
    rows = rows.where((F.col("event_time") > at_ms(from_ms)) & (F.col("event_time") <= at_ms(to_ms)))
    return rows if langs is None else rows.where(F.col("lang").isin(*langs))


def recent_minutes(
    per_minute: DataFrame, to_ms: int, window_s: int, langs: Sequence[str] | None = None
) -> DataFrame:
    """Pre-aggregated minutes in `(floor(to) - window, to]`: whole minutes."""
    from_ms = floor_minute_ms(to_ms) - window_s * 1000
    rows = prune_days(per_minute, from_ms, to_ms)
    rows = rows.where((F.col("minute") > at_ms(from_ms)) & (F.col("minute") <= at_ms(to_ms)))
    return rows if langs is None else rows.where(F.col("lang").isin(*langs))


def _bots() -> Column:
    return F.count_if(F.col("is_bot"))


def window_totals(edits: DataFrame, to_ms: int, window_s: int, langs: Sequence[str]) -> DataFrame:
    """Edits, exact distinct pages and bot edits per language.

    The plan first groups by (lang, namespace, title), so neither a busy language nor a hot page
    lands whole in one task; only partial counts meet on `lang`.
    """
    return (
        recent(edits, to_ms, window_s, langs)
        .groupBy("lang")
        .agg(
            F.count(F.lit(1)).alias("edits"),
            F.count_distinct("namespace", "title").alias("pages"),
            _bots().alias("bot_edits"),
        )
    )


def window_totals_preaggregated(
    edits_per_minute: DataFrame,
    pages: DataFrame,
    to_ms: int,
    window_s: int,
    langs: Sequence[str],
) -> DataFrame:
    """The same totals from minute sums and minute page sets. A language without sets has 0 pages."""
    counted = recent_minutes(pages, to_ms, window_s, langs).groupBy("lang").agg(F.count_distinct("namespace", "title").alias("pages"))
    return totals_with_pages(edits_per_minute, counted, to_ms, window_s, langs)


def totals_with_pages(edits_per_minute: DataFrame, pages: DataFrame, to_ms: int, window_s: int, langs: Sequence[str]) -> DataFrame:
    """Minute sums of a window beside its distinct pages (lang, pages)."""
    edits = (
        recent_minutes(edits_per_minute, to_ms, window_s, langs)
        .groupBy("lang")
        .agg(F.sum("edits").alias("edits"), F.sum("bot_edits").alias("bot_edits"))
    )
    # Both sides hold one row per requested language.
    return edits.join(F.broadcast(pages), "lang", "left").select(
        "lang", "edits", F.coalesce("pages", F.lit(0)).alias("pages"), "bot_edits"
    )


def with_all(totals: DataFrame) -> DataFrame:
    """Per-language totals plus an `all` row (zeros when there are none).

    Pages differ between wikis, so they add up too.
    """
    counts = ("edits", "pages", "bot_edits")
    zero = totals.sparkSession.range(1).select(F.lit("all").alias("lang"), *[F.lit(0).alias(c) for c in counts])
    both = totals.select(F.explode(F.array("lang", F.lit("all"))).alias("lang"), *counts)
    return both.unionByName(zero).groupBy("lang").agg(*[F.sum(c).alias(c) for c in counts])


def top_articles(edits: DataFrame, to_ms: int, window_s: int, per_lang: int) -> DataFrame:
    """Most edited main-namespace titles of each language: edits down, then title up.

    The row-number limit is applied before the shuffle on `lang` as well, so a language's whole
    title list never meets in one task.
    """
    counted = (
        recent(edits, to_ms, window_s)
        .where(F.col("namespace") == 0)
        .groupBy("lang", "title")
        .agg(F.count(F.lit(1)).alias("edits"))
    )
    order = Window.partitionBy("lang").orderBy(F.col("edits").desc(), F.col("title"))
    return (
        counted.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= per_lang)
        .select("lang", "title", "edits")
    )


def lang_order(langs: Sequence[str]) -> Column:
    """A language's place in the configured order, the last tie-break of merged lists."""
    return F.array_position(F.array(*[F.lit(x) for x in langs]), F.col("lang"))


def top_overall(tops: DataFrame, langs: Sequence[str], limit: int) -> DataFrame:
    """Per-language tops merged into one list."""
    return (
        tops.where(F.col("lang").isin(*langs))
        .orderBy(F.col("edits").desc(), F.col("title"), lang_order(langs))
        .limit(limit)
    )
