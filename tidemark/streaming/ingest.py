"""Landed messages to stored edits and their pre-aggregates, each exactly once.

A micro-batch writes under a token made of the query's id and the batch number. A replay computes
the same rows (arrival times and counters come from the messages, what is known already from the writes
of others) and overwrites the same partitions. Raw rows are written first; counts and
page sets are then derived from what was written, so they cannot drift from it.

An event that comes again has its event time again, so it is looked up among the stored rows of its minute: the
ledger names the few writes that hold such minutes, and only these are opened. There is no bound on how long ago, how
many events back or in which run it was stored.

A batch that a rewrite has found uncommitted (see `Tables.fence`) isn't written over it when it is replayed: rows of
rewritten days stay as the rewrite left them, and its minutes are counted again from raw rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.config import DEFAULTS, SEAM_WINDOW_NS, Settings
from tidemark.functions.times import yyyymm
from tidemark.operators import ledger, page_tree, reconcile, rollups, seam
from tidemark.operators.classify import classify, count_outcomes
from tidemark.operators.hours import max_ingest_seq
from tidemark.sources.tables import Held, Tables

LAST = "seq BIGINT"


def _at_once(spark: SparkSession, *jobs: Callable[[], None]) -> None:
    """Run independent writes side by side; the first failure is raised once all have ended."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        running = [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]
    for job in running:
        job.result()


def run_tag(batch: DataFrame) -> str:
    """Names this checkpoint's run: a new checkpoint starts at batch 0 and must not reuse tokens."""
    query_id = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
    if not query_id:
        raise RuntimeError("no streaming query: call write() with a run name of your own")
    return re.sub(r"[^0-9a-zA-Z]", "", query_id)


class Ingest:
    """Handles micro-batches for `foreachBatch`."""

    def __init__(self, tables: Tables, settings: Settings = DEFAULTS, floor_ms: int | None = None):
        self.tables, self.settings, self.floor_ms = tables, settings, floor_ms

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        self.write(batch, run_tag(batch), batch_id)

    def _last_path(self, run: str, batch_id: int) -> str:
        return f"{self.tables.root}/_last/{run}-{batch_id:09d}"

    def _last_seq(self, run: str, batch_id: int, token: str) -> int:
        """The highest sequence number before this batch: the previous batch noted it, a first batch asks the ledger.

        The batch's own rows don't count, so a replay numbers its rows as before.
        """
        tables, before = self.tables, self._last_path(run, batch_id - 1)
        if batch_id > 0 and tables.files.exists(f"{before}/_SUCCESS"):
            return tables.spark.read.schema(LAST).parquet(before).first()["seq"]
        tables.complete_ledger()
        return ledger.max_ingest_seq(tables.ledger().where(F.col("token") != token)).first()["seq"] or 0

    def _note_last(self, seq: int, run: str, batch_id: int) -> None:
        tables = self.tables
        tables.spark.range(1).select(F.lit(seq).cast("bigint").alias("seq")).write.mode("overwrite").parquet(self._last_path(run, batch_id))
        if batch_id > 1:
            tables.files.remove(self._last_path(run, batch_id - 2))

    def _stored(self, arrivals: DataFrame, token: str) -> DataFrame | None:
        """Event ids that other writes hold in the minutes of these arrivals; none if no write holds such a minute."""
        tables = self.tables
        days = [str(r["d"]) for r in arrivals.select(F.to_date("event_time").alias("d")).distinct().collect()]
        others = tables.ledger(days).where(F.col("token") != token)
        minutes = arrivals.select(F.expr("unix_seconds(event_time) div 60").alias("m")).distinct()
        found = [(str(r["dt"]), r["token"]) for r in ledger.sharing_minutes(others, minutes).collect()]
        return tables.read_held(Held("edits", tuple(found))).select("event_id", "event_time") if found else None

    def write(self, batch: DataFrame, run: str, batch_id: int) -> None:
        tables = self.tables
        token = f"{run}-{batch_id:09d}"
        outcomes = classify(batch, self.settings, self.floor_ms).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            bounds = batch.agg(
                F.count(F.lit(1)).alias("n"),
                F.count_if(F.col("position").isNull() | F.col("received_at").isNull()).alias("unplaced"),
                F.min("position").alias("first"),
                F.max("position").alias("last"),
                F.unix_micros(F.min("received_at")).alias("clock_us"),
            ).first()
            if bounds["unplaced"]:
                raise ValueError(f"{bounds['unplaced']} landed messages lack a position or an arrival time")
            last_seq = self._last_seq(run, batch_id, token)
            if not bounds["n"]:
                return self._note_last(last_seq, run, batch_id)
            first_seq = max(last_seq + 1, bounds["clock_us"] * 1000)

            arrivals = outcomes.where("outcome = 'kept'")
            fresh = seam.first_arrivals(arrivals)
            known = self._stored(arrivals, token)
            if known is not None:
                fresh = seam.unseen(fresh, known)
            fresh = seam.numbered(fresh, first_seq, bounds["first"]).withColumn("dt", F.to_date("event_time"))
            fences = tables.fenced(token)
            if fences:
                written = self._rewritten(fresh, token, fences)
            else:
                tables.put("edits", fresh, token)
                written = tables.read_token("edits", token)
            counts, pages = rollups.per_minute(written), rollups.pages_per_minute(written)
            hours = page_tree.per_hour(written).withColumn("dt", F.to_date("hour"))
            _at_once(
                tables.spark,
                lambda: tables.summarize(tables.read_token("edits", token), token),
                lambda: self._recount(written, token, fences) if fences else tables.write_once("edits_per_minute", rollups.with_month(counts), token),
                lambda: tables.write_once("pages_per_minute", rollups.with_day(pages), token),
                lambda: tables.write_once("pages_per_hour", hours, token),
                lambda: tables.write_once("pages_per_day", page_tree.per_day(written), token),
                lambda: tables.write_once("outcomes", _settled(count_outcomes(outcomes), written), token),
                lambda: self._note_last(first_seq + bounds["last"] - bounds["first"], run, batch_id),
            )
        finally:
            outcomes.unpersist()

    def _rewritten(self, fresh: DataFrame, token: str, fences: dict[str, set[str]]) -> DataFrame:
        """Write a fenced batch's rows but for days rewritten since; returns what is stored of the batch, wherever it is."""
        tables = self.tables
        days = sorted(fences.get("edits", set()))
        tables.put("edits", fresh.where(~F.col("dt").cast("string").isin(days)), token)
        written = tables.read_token("edits", token)
        if not days:
            return written
        rewritten = tables.read("edits").where(F.col("dt").cast("string").isin(days) & (F.col("token") != token))
        return written.unionByName(rewritten.join(fresh.select("event_id"), "event_id", "left_semi"))

    def _recount(self, written: DataFrame, token: str, fences: dict[str, set[str]]) -> None:
        """A fenced batch's counts: in rewritten months its minutes are counted again from all raw rows, the others are added."""
        tables = self.tables
        months = sorted(fences.get("edits_per_minute", set()))
        counts = rollups.with_month(rollups.per_minute(written))
        tables.write_once("edits_per_minute", counts.where(~F.col("month").cast("string").isin(months)), token)
        again = counts.where(F.col("month").cast("string").isin(months)).select(F.unix_seconds("minute").alias("minute_s")).distinct()
        again = tables.keep("fenced_minutes", again)
        if again.isEmpty():
            return
        tables.finish_replace("edits_per_minute")
        days = [r["d"] for r in again.select(F.to_date(F.timestamp_seconds("minute_s")).alias("d")).distinct().collect()]
        edits = tables.read("edits").where(F.col("dt").isin(*days))
        held = tables.hold("edits_per_minute", [r["m"] for r in again.select(yyyymm(F.timestamp_seconds("minute_s")).alias("m")).distinct().collect()])
        fixed = reconcile.repaired(edits, tables.read_held(held), again)
        tables.swap(held, rollups.with_month(fixed), f"recount-{token}")

    def start(self, messages: DataFrame, checkpoint: str, available_now: bool = False) -> StreamingQuery:
        writer = messages.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint)
        if available_now:
            return writer.trigger(availableNow=True).start()
        return writer.trigger(processingTime=f"{self.settings.flush_interval_s} seconds").start()


def _settled(counts: DataFrame, written: DataFrame) -> DataFrame:
    """Outcome counts once duplicates are known: kept rows that weren't written."""
    stored = written.agg(F.count(F.lit(1)).alias("n")).scalar()
    kept = counts.where("outcome = 'kept'")
    settled = counts.withColumn("n", F.when(F.col("outcome") == "kept", stored).otherwise(F.col("n")))
    repeats = kept.select(F.lit("duplicate").alias("outcome"), (F.col("n") - stored).alias("n"))
    return settled.unionByName(repeats).where("n > 0")


def stored_tail(edits: DataFrame, limit: int) -> DataFrame:
    """The last `limit` rows by ingest order, reading from a floor that moves back until it holds
    them. The floor lets row groups be skipped; it never decides which rows count."""
    last = max_ingest_seq(edits).first()["seq"]
    if last is None:
        return seam.ingest_tail(edits, limit)
    span = SEAM_WINDOW_NS
    while span < last:
        floor = last - span
        if edits.where(F.col("ingest_seq") >= floor).limit(limit).count() >= limit:
            return seam.ingest_tail(edits, limit, floor)
        span *= 2
    return seam.ingest_tail(edits, limit)
