"""Where ingest picks up after a restart, decided from the stored rows alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import DAY_S, DEFAULTS, HOUR_S, MINUTE_S, RESTORE_MARGIN_S, Settings
from tidemark.operators import ledger as batches
from tidemark.operators.seam import latest_bookmark

MINUTE_MS, HOUR_MS, DAY_MS = MINUTE_S * 1000, HOUR_S * 1000, DAY_S * 1000


def _floor(column: str, unit_ms: int):
    return F.expr(f"{column} div {unit_ms} * {unit_ms}")


def stored_position(edits: DataFrame | None, edits_per_minute: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """One row: the stored rows' extent, the last row's stream id, the pre-aggregate's last minute.

    With a ledger no raw row is read.
    """
    last_minute = edits_per_minute.agg(F.unix_millis(F.max("minute")).alias("m")).scalar()
    if ledger is not None:
        return batches.extent(ledger).select(
            "newest_ms",
            "oldest_ms",
            F.col("stored_ms").alias("ingested_ms"),
            F.coalesce("seq", F.lit(0)).alias("last_seq"),
            last_minute.alias("rollup_ms"),
            F.coalesce(batches.latest_bookmark(ledger).scalar(), F.lit("")).alias("sse_id"),
        )
    return edits.agg(
        F.unix_millis(F.max("event_time")).alias("newest_ms"),
        F.unix_millis(F.min("event_time")).alias("oldest_ms"),
        F.unix_millis(F.max("ingested_at")).alias("ingested_ms"),
        F.coalesce(F.max("ingest_seq"), F.lit(0)).alias("last_seq"),
    ).withColumns({"rollup_ms": last_minute, "sse_id": F.coalesce(latest_bookmark(edits).scalar(), F.lit(""))})


def resume_state(
    edits: DataFrame | None, edits_per_minute: DataFrame, now_ms: int, settings: Settings = DEFAULTS, ledger: DataFrame | None = None
) -> DataFrame:
    """One row, from the ledger if one is given. `start` is one of

    - first_boot: nothing stored; begin `first_boot_lookback_s` ago.
    - after_rollup: raw rows expired; begin after the pre-aggregate's last minute (a gap from it).
    - too_old: the source no longer has the newest event; begin afresh and record the gap.
    - after_restore: rows came back from the archive without a stream id; replay from a margin
      before them and drop events older than the restored days.
    - bookmark: continue from the last row's stream id.

    `bookmark` or `since_ms` is set, never both. Times are unix ms.
    """
    kept_from = now_ms - settings.source_retention_s * 1000
    fresh = now_ms - settings.first_boot_lookback_s * 1000
    null = F.lit(None).cast("bigint")

    start = (
        F.when(F.col("newest_ms").isNull() & F.col("rollup_ms").isNull(), "first_boot")
        .when(F.col("newest_ms").isNull(), "after_rollup")
        .when(F.col("newest_ms") < kept_from, "too_old")
        .when(F.col("sse_id") == "", "after_restore")
        .otherwise("bookmark")
    )
    rows = stored_position(edits, edits_per_minute, ledger).withColumn("start", start)

    after_minute = F.col("rollup_ms") + MINUTE_MS
    hour_end = F.expr(f"(newest_ms + {HOUR_MS - 1}) div {HOUR_MS} * {HOUR_MS}")
    replay = F.least(F.col("ingested_ms"), hour_end) - RESTORE_MARGIN_S * 1000
    lost = replay < kept_from

    def by_case(**values):
        picked = null
        for name, value in values.items():
            picked = F.when(F.col("start") == name, value).otherwise(picked)
        return picked.cast("bigint")

    from_rollup = F.least(F.greatest(after_minute, F.lit(kept_from)), F.lit(now_ms))
    from_restore = F.greatest(replay, F.lit(kept_from))
    return rows.select(
        "start",
        F.when(F.col("start") == "bookmark", F.col("sse_id")).alias("bookmark"),
        by_case(
            first_boot=F.lit(fresh), after_rollup=from_rollup, too_old=F.lit(fresh), after_restore=from_restore
        ).alias("since_ms"),
        by_case(after_rollup=after_minute, after_restore=_floor("oldest_ms", DAY_MS)).alias("floor_ms"),
        "last_seq",
        by_case(bookmark=F.col("newest_ms")).alias("newest_ms"),
        by_case(
            after_rollup=F.col("rollup_ms"),
            too_old=_floor("newest_ms", MINUTE_MS),
            after_restore=F.when(lost, hour_end),
        ).alias("gap_from_ms"),
        by_case(
            after_rollup=from_rollup, too_old=F.lit(fresh), after_restore=F.when(lost, F.lit(kept_from))
        ).alias("gap_to_ms"),
    )


def gap_row(state: DataFrame, now_ms: int, reason: str = "retention") -> DataFrame:
    """The gap a resume must record, if any, as an `ingest_gaps` row."""
    return state.where("gap_from_ms IS NOT NULL").select(
        F.timestamp_millis(F.lit(now_ms)).alias("detected_at"),
        F.timestamp_millis("gap_from_ms").alias("gap_from"),
        F.timestamp_millis("gap_to_ms").alias("gap_to"),
        F.lit(reason).alias("reason"),
    )


def expired_bookmark(state: DataFrame, now_ms: int, settings: Settings = DEFAULTS) -> DataFrame:
    """A bookmark that aged past the source's retention while ingest was up: start afresh and say
    what is missing. No row while it is still good."""
    fresh = now_ms - settings.first_boot_lookback_s * 1000
    old = F.col("newest_ms") < now_ms - settings.source_retention_s * 1000
    return state.where(F.col("bookmark").isNotNull() & old).select(
        F.lit(fresh).cast("bigint").alias("since_ms"),
        _floor("newest_ms", MINUTE_MS).alias("gap_from_ms"),
        F.lit(fresh).cast("bigint").alias("gap_to_ms"),
    )
