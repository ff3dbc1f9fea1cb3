"""The per-minute chart: densified minutes, with unknown kept apart from zero."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.times import at_ms, minute, ms
from tidemark.operators.windows import MINUTE_MS, floor_minute_ms, prune_days

Langs = Sequence[str]


def minute_parts(edits_per_minute: DataFrame, edits: DataFrame, to_ms: int, minutes: int) -> DataFrame:
    """What the chart adds up: partials of finished minutes from the pre-aggregate, and each raw row
    of the minute still filling, up to `to`."""
    current = floor_minute_ms(to_ms)
    first = current - minutes * MINUTE_MS
    finished = prune_days(edits_per_minute, first, current).where(
        (F.col("minute") > at_ms(first)) & (F.col("minute") < at_ms(current))
    )
    filling = prune_days(edits, current, to_ms).where(
        (F.col("event_time") >= at_ms(current)) & (F.col("event_time") <= at_ms(to_ms))
    )
    return finished.selectExpr("unix_seconds(minute) AS minute_s", "lang", "edits").unionAll(
        filling.selectExpr(f"{current // 1000}L AS minute_s", "lang", "1L AS edits")
    )


def edits_per_minute_series(edits_per_minute: DataFrame, edits: DataFrame, to_ms: int, minutes: int) -> DataFrame:
    """Edits per minute and language over the chart, one shuffle for both sources."""
    parts = minute_parts(edits_per_minute, edits, to_ms, minutes)
    return parts.groupBy("minute_s", "lang").agg(F.sum("edits").alias("edits"))


def recent_gaps(gaps: DataFrame, to_ms: int, minutes: int) -> DataFrame:
    """Gaps that overlap the chart's last `minutes` minutes."""
    return gaps.where(
        (F.col("gap_to") > at_ms(to_ms - minutes * MINUTE_MS)) & (F.col("gap_from") <= at_ms(to_ms))
    )


def gap_minutes(gaps: DataFrame, first_ms: int, last_ms: int) -> DataFrame:
    """Chart minutes `[first, last]` that any gap touches (`from < minute end` and `to > minute`).

    Each gap is clipped to the chart and exploded, at most one row a chart minute, so the overlap
    needs no range join.
    """
    start = F.greatest(ms(minute("gap_from")), F.lit(first_ms))
    stop = F.least(ms(minute(F.timestamp_millis(ms("gap_to") - 1))), F.lit(last_ms))
    return (
        gaps.select(start.alias("start"), stop.alias("stop"))
        .where("start <= stop")
        .select(F.explode(F.sequence("start", "stop", F.lit(MINUTE_MS))).alias("minute_ms"))
        .select((F.col("minute_ms") / 1000).cast("bigint").alias("minute_s"))
    )


def minute_series(
    counts: DataFrame, gaps: DataFrame | None, to_ms: int, minutes: int, langs: Langs
) -> DataFrame:
    """`lang, t, edits, partial` for each chart minute, each language and `all`.

    `counts` may hold several rows per minute and language; they add up. A minute is known when any
    language has a row in it and no gap touches it; then a language without rows is 0. Otherwise
    every value of the minute is NULL. Spine, counts and gap minutes meet in one grouping by minute:
    no joins.
    """
    last = floor_minute_ms(to_ms)
    first = last - (minutes - 1) * MINUTE_MS
    rows = counts.where(F.col("lang").isin(*langs)).selectExpr("minute_s", "lang", "edits", "false AS gap")
    spine = counts.sparkSession.range(first // 1000, last // 1000 + 1, 60, 1)
    rows = rows.unionAll(spine.selectExpr("id AS minute_s", "NULL AS lang", "NULL AS edits", "false AS gap"))
    if gaps is not None:
        blank = gap_minutes(recent_gaps(gaps, to_ms, minutes), first, last)
        rows = rows.unionAll(blank.selectExpr("minute_s", "NULL AS lang", "NULL AS edits", "true AS gap"))
    per_lang = [f"coalesce(sum(edits) FILTER (WHERE lang = '{x}'), 0L) AS n_{x}" for x in langs]
    minute_rows = (
        rows.where(F.col("minute_s").between(first // 1000, last // 1000))
        .groupBy("minute_s")
        .agg(*[F.expr(e) for e in ("count(edits) > 0 AND NOT bool_or(gap) AS known", "sum(edits) AS n_all", *per_lang)])
    )
    values = ", ".join(f"named_struct('lang', '{x}', 'edits', if(known, n_{x}, NULL))" for x in [*langs, "all"])
    return minute_rows.selectExpr("minute_s", f"inline(array({values}))").selectExpr(
        "lang", "minute_s AS t", "edits", f"minute_s = {last // 1000} AS partial"
    )
