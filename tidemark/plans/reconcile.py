"""Check the pre-aggregate against raw rows, and count the minutes that disagree again."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import DEFAULTS, Settings
from tidemark.functions.times import yyyymm
from tidemark.operators import ledger, reconcile, rollups
from tidemark.plans import page_sets
from tidemark.sources.tables import Tables

MISMATCH = "minute_s BIGINT, lang STRING, raw BIGINT, rolled BIGINT"


class IngestRunning(RuntimeError):
    """Rows are arriving: rewriting their minutes could count an event twice."""


@dataclass(frozen=True)
class Mark:
    """Where ingest stood when a rewrite began."""

    seq: int
    last_ms: int
    n: int


def _mark(tables: Tables) -> Mark:
    row = ledger.ingest_mark(tables.ledger()).first()
    return Mark(row["seq"], row["last_ms"], row["n"])


def require_quiet(tables: Tables, now_ms: int, quiet_s: int = DEFAULTS.quiet_s) -> Mark:
    mark = _mark(tables)
    if mark.n and now_ms - mark.last_ms < quiet_s * 1000:
        raise IngestRunning("rows are still arriving; stop ingest first")
    return mark


def require_unchanged(tables: Tables, mark: Mark) -> None:
    now = _mark(tables)
    if (now.seq, now.last_ms) != (mark.seq, mark.last_ms):
        raise IngestRunning("ingest wrote during the rewrite; stop it and run again")


def find_mismatches(tables: Tables, now_ms: int, settings: Settings = DEFAULTS) -> DataFrame:
    """Settled whole minutes where raw and the pre-aggregate disagree; empty if nothing is settled."""
    oldest_ms = tables.oldest_ms()
    if oldest_ms is not None:
        from_s, to_s = reconcile.settled_range(oldest_ms // 1000, now_ms, settings.reconcile_settle_s)
        if to_s > from_s:
            return reconcile.mismatches(tables.read("edits"), tables.read("edits_per_minute"), from_s, to_s)
    return tables.spark.createDataFrame([], MISMATCH)


def repair(tables: Tables, mismatches: DataFrame, now_ms: int, settings: Settings = DEFAULTS) -> int:
    """Count every listed minute again, all languages, and top up its page sets; returns minutes.

    The months the minutes fall in are folded with the new counts; rerunning after an interruption is safe.
    """
    tables.finish_replace("edits_per_minute")
    minutes = tables.keep("repair_minutes", mismatches.select("minute_s").distinct())
    months = [r["m"] for r in minutes.select(yyyymm(F.timestamp_seconds("minute_s")).alias("m")).distinct().collect()]
    if not months:
        return 0
    mark = require_quiet(tables, now_ms, settings.quiet_s)
    days = [r["d"] for r in minutes.select(F.to_date(F.timestamp_seconds("minute_s")).alias("d")).distinct().collect()]
    edits = tables.read("edits").where(F.col("dt").isin(*days))
    tables.fence("edits_per_minute", months, f"repair-{now_ms}")
    held = tables.hold("edits_per_minute", months)
    fixed = reconcile.repaired(edits, tables.read_held(held), minutes)
    tables.swap(held, rollups.with_month(fixed), f"repair-{now_ms}")
    page_sets.add_pages(tables, reconcile.of_minutes(edits, minutes), f"repair-{now_ms}")
    require_unchanged(tables, mark)
    return minutes.count()
