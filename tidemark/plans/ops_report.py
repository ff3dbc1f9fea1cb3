"""The operations report: ingest, freshness objective, gaps and cost in one document."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import DEFAULTS, GAP_WINDOW_DAYS, LAG_WINDOW_S, RECONNECT_WINDOW_S, Settings
from tidemark.functions import bookmark, status
from tidemark.functions.times import at_ms, iso
from tidemark.operators import ledger as batches
from tidemark.operators.costs import cost_figure
from tidemark.operators.gaps import gaps_with_total
from tidemark.operators.hours import head
from tidemark.operators.lag import reconnects_by_reason, stored_lag
from tidemark.operators.seam import latest_bookmark
from tidemark.operators.slo import slo_report


def _iso_ms(column: str):
    return iso(F.timestamp_millis(column))


def ingest_section(
    edits: DataFrame, reconnects: DataFrame, now_ms: int, settings: Settings = DEFAULTS, ledger: DataFrame | None = None
) -> DataFrame:
    """With a ledger, `edits` need only be the rows stored in the last hour (`Tables.stored_since`)."""
    lag = stored_lag(edits, now_ms).select(
        F.struct(
            F.col("p50_ms").alias("p50"), F.col("p95_ms").alias("p95"), "events", F.lit(LAG_WINDOW_S).alias("window_s")
        ).alias("lag")
    )
    last = latest_bookmark(edits) if ledger is None else batches.latest_bookmark(ledger)
    position = last.select(bookmark.shorten("sse_id").alias("bookmark"))
    # One entry per reason: a fixed vocabulary.
    reasons = reconnects_by_reason(reconnects, now_ms).agg(
        F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "reason", "n"))).alias("r")
    )
    dropped = reasons.select(
        F.struct(
            F.lit(RECONNECT_WINDOW_S).alias("window_s"),
            F.aggregate("r", F.lit(0).cast("bigint"), lambda acc, x: acc + x["n"]).alias("total"),
            F.map_from_entries(F.transform("r", lambda x: F.struct(x["reason"], x["n"]))).alias("by_reason"),
        ).alias("reconnects")
    )
    return (head(edits) if ledger is None else batches.head(ledger)).select(
        F.struct(
            status.ingest_state("newest_ms", "stored_ms", now_ms, settings.stale_after_s).alias("state"),
            _iso_ms("newest_ms").alias("newest_event_at"),
            _iso_ms("stored_ms").alias("last_stored_at"),
            F.lit(float(settings.stale_after_s)).alias("stale_after_s"),
            lag.scalar().alias("lag_ms"),
            position.scalar().alias("bookmark"),
            dropped.scalar().alias("reconnects"),
        ).alias("ingest")
    )


def gaps_section(gaps: DataFrame, now_ms: int) -> DataFrame:
    """The newest gaps, newest first, and how many there were: at most `MAX_GAPS` rows are folded."""
    rows = gaps_with_total(gaps, now_ms)
    entry = F.struct(
        _iso_ms("from_ms").alias("from"), _iso_ms("to_ms").alias("to"), "duration_s", "reason"
    )
    ordered = F.array_sort(
        F.collect_list(F.struct((-F.col("from_ms")).alias("a"), (-F.col("to_ms")).alias("b"), "reason", entry.alias("e")))
    )
    return rows.agg(ordered.alias("o"), F.coalesce(F.max("total"), F.lit(0)).alias("total")).select(
        F.struct(
            F.lit(GAP_WINDOW_DAYS).alias("window_days"), "total", F.transform("o", lambda x: x["e"]).alias("recent")
        ).alias("gaps")
    )


def cost_sections(costs: DataFrame, now_ms: int, settings: Settings = DEFAULTS) -> DataFrame:
    """This month's latest good figure (or NULL), and how today's attempt went. Never error text."""
    month = datetime.fromtimestamp(now_ms // 1000, timezone.utc).date().replace(day=1)
    figure = F.struct(
        F.col("fig_amount").alias("amount"),
        F.col("fig_currency").alias("currency"),
        F.col("fig_estimated").alias("estimated"),
        F.col("fig_period_start").cast("string").alias("period_start"),
        F.col("fig_period_end").cast("string").alias("period_end"),
        _iso_ms("figure_ms").alias("fetched_at"),
        F.lit(settings.cost_source).alias("source"),
    )
    return cost_figure(costs, month).select(
        F.when(F.col("figures") > 0, figure).alias("cost"),
        F.struct(
            status.cost_check("fetched_ms", "last_ok", now_ms).alias("today"), _iso_ms("fetched_ms").alias("last_attempt_at")
        ).alias("cost_check"),
    )


def ops_report(
    edits: DataFrame,
    reconnects: DataFrame,
    samples: DataFrame,
    gaps: DataFrame,
    costs: DataFrame,
    now_ms: int,
    settings: Settings = DEFAULTS,
    ledger: DataFrame | None = None,
) -> DataFrame:
    """One row, one struct a section; `ledger` as in `ingest_section`. Sections are scalar subqueries and run side by side."""
    freshness = slo_report(samples, now_ms, settings.slo_target, settings.slo_threshold_s)
    money = cost_sections(costs, now_ms, settings).select(F.struct("*").alias("m")).scalar()
    return (
        edits.sparkSession.range(1)
        .select(
            iso(at_ms(now_ms)).alias("generated_at"),
            ingest_section(edits, reconnects, now_ms, settings, ledger).scalar().alias("ingest"),
            freshness.select(F.struct("*").alias("f")).scalar().alias("freshness"),
            gaps_section(gaps, now_ms).scalar().alias("gaps"),
            money.alias("m"),
        )
        .select("generated_at", "ingest", "freshness", "gaps", F.col("m.cost").alias("cost"), F.col("m.cost_check").alias("cost_check"))
    )
