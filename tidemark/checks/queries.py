"""Registered queries: each reads the given tables whole and returns one DataFrame.

Times come out as unix seconds or milliseconds, documents as compact JSON, so two engines' results
can be compared value by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import DEFAULTS, LANGS, SNAPSHOT_MINUTES, SNAPSHOT_WINDOW_S, TOP_N, WINDOWS_S
from tidemark.functions import bookmark, status, text, times
from tidemark.functions.ratios import share
from tidemark.operators import classify as classify_ops
from tidemark.operators import costs, gaps, hours, lag, reconcile, rollups, seam, series, slo, windows
from tidemark.plans import activity as activity_plan
from tidemark.plans import ops_report, resume, snapshot
from tidemark.plans.archive import due_range
from tidemark.session import prepare
from tidemark.sources import given_tables as given

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

NOW_AFTER_NEWEST_MS = 30_000


def query(fn: Query) -> Query:
    """Register under the function's name, with the session settings results depend on."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(prepare(spark), sf_dir)

    QUERIES[fn.__name__] = run
    return fn


def register(name: str, fn: Query) -> None:
    QUERIES[name] = lambda spark, sf_dir: fn(prepare(spark), sf_dir)


class Inputs:
    """The derived inputs of one query over one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self.edits = given.edits(spark, sf_dir)

    @property
    def to_ms(self) -> int:
        return windows.newest_ms(self.edits)

    @property
    def now_ms(self) -> int:
        return self.to_ms + NOW_AFTER_NEWEST_MS

    @property
    def rollup(self) -> DataFrame:
        return rollups.per_minute(self.edits)

    @property
    def pages(self) -> DataFrame:
        return rollups.pages_per_minute(self.edits)

    @property
    def drifted(self) -> DataFrame:
        """The true rollup with some of en's minutes lost."""
        lost = (F.col("lang") == "en") & ((F.unix_seconds("minute") / 60).cast("bigint") % 97 == 0)
        return self.rollup.where(~lost)

    def derived(self, name: str) -> DataFrame:
        return getattr(given, name)(self.spark, self.dir)

    @property
    def costs(self) -> DataFrame:
        return costs.parse_answers(self.derived("cost_answers"))


# --- windows -------------------------------------------------------------------------------------


@query
def newest(spark, sf_dir):
    return windows.newest(given.edits(spark, sf_dir))


def _window_totals(name: str) -> Query:
    def run(spark, sf_dir):
        i = Inputs(spark, sf_dir)
        return windows.window_totals(i.edits, i.to_ms, WINDOWS_S[name], LANGS)

    return run


for _name in WINDOWS_S:
    register(f"window_totals_{_name}", _window_totals(_name))


@query
def window_totals_all(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return windows.with_all(windows.window_totals(i.edits, i.to_ms, WINDOWS_S["24h"], LANGS)).withColumn(
        "bot_share", share("bot_edits", "edits")
    )


def _preaggregated(name: str) -> Query:
    def run(spark, sf_dir):
        i = Inputs(spark, sf_dir)
        return windows.window_totals_preaggregated(i.rollup, i.pages, i.to_ms, WINDOWS_S[name], LANGS)

    return run


for _name in ("24h", "3d", "7d"):
    register(f"window_from_rollup_{_name}", _preaggregated(_name))


@query
def top_articles(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return windows.top_articles(i.edits, i.to_ms, WINDOWS_S["7d"], TOP_N)


@query
def top_articles_5m(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return windows.top_articles(i.edits, i.to_ms, SNAPSHOT_WINDOW_S, TOP_N)


@query
def top_articles_all(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    tops = windows.top_articles(i.edits, i.to_ms, WINDOWS_S["7d"], TOP_N)
    return windows.top_overall(tops, LANGS, TOP_N).withColumn("url", text.article_url("lang", "title"))


# --- series --------------------------------------------------------------------------------------


@query
def edits_per_minute(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return series.edits_per_minute_series(i.rollup, i.edits, i.to_ms, SNAPSHOT_MINUTES)


def _series(with_gaps: bool) -> Query:
    def run(spark, sf_dir):
        i = Inputs(spark, sf_dir)
        to_ms = i.to_ms
        counts = series.edits_per_minute_series(i.rollup, i.edits, to_ms, SNAPSHOT_MINUTES)
        holes = i.derived("gaps") if with_gaps else None
        return series.minute_series(counts, holes, to_ms, SNAPSHOT_MINUTES, LANGS)

    return run


register("minute_series_60", _series(False))
register("minute_series_with_gaps", _series(True))


@query
def recent_gaps(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    found = series.recent_gaps(i.derived("gaps"), i.to_ms, SNAPSHOT_MINUTES)
    return found.select(times.ms("gap_from").alias("from_ms"), times.ms("gap_to").alias("to_ms"))


@query
def gaps_with_total(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return gaps.gaps_with_total(i.derived("gaps"), i.now_ms)


# --- pre-aggregates ------------------------------------------------------------------------------


@query
def rollup_per_minute(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return i.rollup.withColumn("minute_s", times.seconds("minute")).drop("minute")


@query
def pages_per_minute(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return i.pages.withColumn("minute_s", times.seconds("minute")).drop("minute")


@query
def rollup_merged_partials(spark, sf_dir):
    """Partials of many batches (one per ingest thousand), summed at read."""
    i = Inputs(spark, sf_dir)
    batches = i.edits.groupBy(
        F.expr("ingest_seq div 1000").alias("b"), times.minute("event_time").alias("minute"), "lang"
    ).agg(F.count(F.lit(1)).alias("edits"), F.count_if(F.col("is_bot")).alias("bot_edits"))
    return rollups.merge_counts(batches).withColumn("minute_s", times.seconds("minute")).drop("minute")


@query
def pages_merged_twice(spark, sf_dir):
    """Adding every page set a second time changes nothing."""
    i = Inputs(spark, sf_dir)
    return rollups.merge_pages(i.pages, i.pages).withColumn("minute_s", times.seconds("minute")).drop("minute")


@query
def pages_per_hour(spark, sf_dir):
    return rollups.pages_per_hour(Inputs(spark, sf_dir).pages)


@query
def minute_coverage(spark, sf_dir):
    return rollups.minute_coverage(given.edits(spark, sf_dir))


@query
def newest_rollup_minute(spark, sf_dir):
    return rollups.newest_minute(Inputs(spark, sf_dir).rollup)


@query
def staged_hours(spark, sf_dir):
    return rollups.staged_hours(Inputs(spark, sf_dir).rollup)


# --- lag and operations --------------------------------------------------------------------------


@query
def ingest_lag_quantiles(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return lag.ingest_lag(i.edits, i.to_ms)


@query
def stored_lag_last_hour(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return lag.stored_lag(i.edits, i.now_ms)


@query
def stored_lag_month(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return lag.stored_lag(i.edits, i.now_ms, 31 * 86_400)


@query
def reconnects_by_reason(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return lag.reconnects_by_reason(i.derived("reconnects"), i.now_ms)


@query
def first_sample(spark, sf_dir):
    return slo.first_sample(given.samples(spark, sf_dir))


@query
def freshness_minutes(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    end_s = i.to_ms // 60_000 * 60
    return slo.freshness(i.derived("samples"), DEFAULTS.slo_threshold_s, end_s - 30 * 86_400, end_s)


@query
def slo_window(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return slo.slo_window(slo.first_sample(i.derived("samples")), i.now_ms)


@query
def slo_report(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return slo.slo_report(i.derived("samples"), i.now_ms, DEFAULTS.slo_target, DEFAULTS.slo_threshold_s)


@query
def freshness_sample(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return slo.freshness_sample(i.edits, i.now_ms).select(
        times.seconds("minute").alias("minute_s"), times.ms("sampled_at").alias("sampled_ms"), "age_s"
    )


@query
def cost_answers(spark, sf_dir):
    parsed = Inputs(spark, sf_dir).costs
    return parsed.select(
        times.ms("fetched_at").alias("fetched_ms"),
        "ok",
        F.col("period_start").cast("string").alias("period_start"),
        F.col("period_end").cast("string").alias("period_end"),
        "amount",
        "currency",
        "estimated",
        "error",
    )


@query
def cost_figure(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    figure = costs.cost_figure(i.costs, times.day_of_ms(i.now_ms).replace(day=1))
    return figure.withColumns(
        {c: F.col(c).cast("string") for c in ("fig_period_start", "fig_period_end")}
    )


@query
def cost_check(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    now_ms = i.now_ms
    figure = costs.cost_figure(i.costs, times.day_of_ms(now_ms).replace(day=1))
    return figure.select(status.cost_check("fetched_ms", "last_ok", now_ms).alias("today"), "fetched_ms")


@query
def cost_attempts_today(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return costs.recorded_on(i.costs, i.now_ms)


@query
def head(spark, sf_dir):
    return hours.head(given.edits(spark, sf_dir))


@query
def ingest_state(spark, sf_dir):
    """The state as judged at several moments after the newest event."""
    i = Inputs(spark, sf_dir)
    to_ms = i.to_ms
    found = hours.head(i.edits)
    moments = F.array(
        *[
            F.struct(
                F.lit(after).alias("after_ms"),
                status.ingest_state("newest_ms", "stored_ms", to_ms + after, DEFAULTS.stale_after_s).alias("state"),
                status.snapshot_status("newest_ms", to_ms + after, DEFAULTS.stale_after_s).alias("snapshot_status"),
            )
            for after in (0, 60_000, 60_100, 61_500, 600_000)
        ]
    )
    return found.select(F.inline(moments))


# --- ingest --------------------------------------------------------------------------------------


@query
def classify_outcomes(spark, sf_dir):
    return classify_ops.count_outcomes(classify_ops.classify(given.messages(spark, sf_dir)))


@query
def classified_rows(spark, sf_dir):
    rows = classify_ops.classify(given.messages(spark, sf_dir)).where("outcome = 'kept'")
    return rows.select(
        "position",
        "event_id",
        times.ms("event_time").alias("event_ms"),
        times.ms("ingested_at").alias("ingested_ms"),
        "wiki",
        "lang",
        "type",
        "namespace",
        "title",
        "is_bot",
        "sse_id",
    )


@query
def seam_dedup(spark, sf_dir):
    """Messages once each: repeats inside the batch, then ids among those stored, however many."""
    kept = classify_ops.classify(given.messages(spark, sf_dir)).where("outcome = 'kept'")
    stored = given.edits(spark, sf_dir).withColumn(
        "event_id", F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad("event_id", 12, "0"))
    )
    fresh = seam.unseen(seam.first_arrivals(kept), stored.where(F.col("is_bot")))
    return seam.numbered(fresh, 1_000, 0).select("event_id", "position", "ingest_seq", times.ms("event_time").alias("event_ms"))


@query
def ingest_tail(spark, sf_dir):
    return seam.ingest_tail(given.edits(spark, sf_dir), DEFAULTS.seam_ids)


@query
def latest_bookmark(spark, sf_dir):
    return seam.latest_bookmark(given.edits(spark, sf_dir))


@query
def max_ingest_seq(spark, sf_dir):
    return hours.max_ingest_seq(given.edits(spark, sf_dir))


@query
def batch_token(spark, sf_dir):
    tokens = seam.batch_tokens(given.edits(spark, sf_dir), DEFAULTS.flush_max_rows)
    return tokens.withColumn("day", F.col("day").cast("string"))


@query
def bookmark_positions(spark, sf_dir):
    rows = given.edits(spark, sf_dir).select("event_id", F.explode(bookmark.positions("sse_id")).alias("p"), F.octet_length("sse_id").alias("bytes"))
    return rows.select("event_id", F.col("p.stream").alias("stream"), F.col("p.at").alias("at"), F.col("p.offset").alias("offset"), "bytes")


@query
def resume_state(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return resume.resume_state(i.edits, i.rollup, i.now_ms)


@query
def resume_after_restore(spark, sf_dir):
    """The same rows as they come back from the archive: no stream ids."""
    i = Inputs(spark, sf_dir)
    restored = hours.restored_rows(i.edits.withColumns({"hour": F.lit("00"), "dt": F.to_date("event_time")}))
    return resume.resume_state(restored, i.rollup, i.now_ms)


# --- scalar functions over every event -----------------------------------------------------------


@query
def article_url(spark, sf_dir):
    """Addresses of titles with spaces and reserved characters."""
    rows = given.base(spark, sf_dir).select(
        "event_id",
        "lang",
        F.concat(F.lit("A (b) * ~ ü/ß "), F.col("event_type"), F.lit(" "), (F.col("user_id") % 50).cast("string")).alias("title"),
    )
    return rows.select("event_id", text.article_url("lang", "title").alias("url"), text.lang_of(F.concat("lang", F.lit("wiki"))).alias("lang"))


@query
def archive_paths(spark, sf_dir):
    """Each event's hour as a path and back; paths with impossible dates give no hour."""
    rows = given.edits(spark, sf_dir).select("event_id", times.hour("event_time").alias("h"))
    rows = rows.select("event_id", "h", F.concat(F.lit("s3a://b/e/"), text.hour_path("h")).alias("path"))
    broken = F.regexp_replace("path", r"dt=\d{4}-\d{2}", "dt=2024-02-30-")
    return rows.select(
        "event_id",
        "path",
        times.seconds(text.hour_of_path(F.concat("path", F.lit("/part-0.parquet")))).alias("hour_s"),
        times.seconds(text.hour_of_path(F.concat("path", F.lit(".parquet")))).alias("file_hour_s"),
        times.seconds(text.hour_of_path(F.concat(broken, F.lit(".parquet")))).alias("broken_s"),
    )


@query
def share_ties(spark, sf_dir):
    """Shares that lie on or beside a half at four places, by the orders' own keys."""
    keys = spark.read.parquet(f"{sf_dir}/orders.parquet").select((F.col("o_orderkey") % 20_000).alias("part"))
    parts = keys.distinct().select("part", F.explode(F.array(*(F.lit(n).cast("bigint") for n in (20_000, 24_640, 20_480)))).alias("whole"))
    return parts.where("part <= whole").select("part", "whole", share("part", "whole").alias("share"))


@query
def time_functions(spark, sf_dir):
    e = F.col("event_time")
    return given.edits(spark, sf_dir).select(
        "event_id",
        times.seconds(times.minute(e)).alias("minute_s"),
        times.seconds(times.hour(e)).alias("hour_s"),
        times.seconds(times.ceil_hour(e)).alias("ceil_hour_s"),
        times.day_start_s(e).alias("day_s"),
        times.yyyymm(e).cast("bigint").alias("yyyymm"),
        times.ms(e).alias("ms"),
        times.nanos(e).alias("ns"),
        times.iso(e).alias("iso"),
        times.lag_ms("event_time", "ingested_at").alias("lag_ms"),
        times.days_in_month(e).cast("bigint").alias("month_days"),
        times.month_start(e).cast("string").alias("month"),
    )


# --- hours ---------------------------------------------------------------------------------------


@query
def hour_counts(spark, sf_dir):
    return hours.hour_counts(given.edits(spark, sf_dir))


@query
def raw_span(spark, sf_dir):
    return hours.raw_span(given.edits(spark, sf_dir))


@query
def recorded_counts_latest(spark, sf_dir):
    return hours.recorded_counts(given.recorded_hours(spark, sf_dir))


@query
def archive_plan_due(spark, sf_dir):
    """Finished hours of the last week whose file holds fewer rows than raw."""
    i = Inputs(spark, sf_dir)
    span = hours.raw_span(i.edits).first()
    from_s, to_s = due_range(span["oldest_ms"], span["newest_ms"], i.now_ms)
    raw = hours.hour_counts(i.edits, from_s, to_s)
    return hours.due_hours(raw, hours.recorded_counts(i.derived("recorded_hours"), from_s, to_s))


@query
def missing_hours(spark, sf_dir):
    """Hours between the first and the last event that the ledger never recorded."""
    span = hours.raw_span(given.edits(spark, sf_dir)).first()
    spine = hours.hour_spine(spark, span["oldest_ms"] // 3_600_000 * 3600, span["newest_s"])
    return hours.missing_hours(spine, hours.recorded_counts(given.recorded_hours(spark, sf_dir)))


@query
def unfilled_hours(spark, sf_dir):
    """Recorded hours whose page sets were never recorded as filled (here: every third)."""
    recorded = hours.recorded_counts(given.recorded_hours(spark, sf_dir))
    done = given.recorded_hours(spark, sf_dir).where("unix_seconds(hour) div 3600 % 3 <> 0")
    return hours.missing_hours(recorded, hours.filled_hours(done.withColumnRenamed("written_at", "filled_at")))


@query
def short_hours(spark, sf_dir):
    """Hours whose rebuilt minutes don't add up to what their file is recorded to hold."""
    i = Inputs(spark, sf_dir)
    return hours.short_hours(hours.recorded_counts(i.derived("recorded_hours")), rollups.staged_hours(i.rollup))


@query
def month_pieces(spark, sf_dir):
    """The span from each event's day to 45 days later, split at month starts, counted."""
    days = given.edits(spark, sf_dir).select(
        F.to_date("event_time").alias("first_day"), F.date_add(F.to_date("event_time"), 45).alias("end_day")
    )
    return (
        hours.month_pieces(days)
        .groupBy(F.col("piece_from").cast("string").alias("piece_from"), F.col("piece_to").cast("string").alias("piece_to"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


# --- reconcile -----------------------------------------------------------------------------------


@query
def reconcile_mismatches(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    span = hours.raw_span(i.edits).first()
    from_s, to_s = reconcile.settled_range(span["oldest_ms"] // 1000, i.now_ms, DEFAULTS.reconcile_settle_s)
    return reconcile.mismatches(i.edits, i.drifted, from_s, to_s)


@query
def reconcile_repair(spark, sf_dir):
    """The drifted rollup after its mismatched minutes are counted again."""
    i = Inputs(spark, sf_dir)
    span = hours.raw_span(i.edits).first()
    from_s, to_s = reconcile.settled_range(span["oldest_ms"] // 1000, i.now_ms, DEFAULTS.reconcile_settle_s)
    wrong = reconcile.mismatches(i.edits, i.drifted, from_s, to_s).select("minute_s")
    fixed = reconcile.repaired(i.edits, i.drifted, wrong)
    return fixed.withColumn("minute_s", times.seconds("minute")).drop("minute")


# --- reports -------------------------------------------------------------------------------------


@query
def snapshot_langs(spark, sf_dir):
    """The snapshot, one row per language, lists as JSON."""
    i = Inputs(spark, sf_dir)
    rows = snapshot.snapshot_langs(i.edits, i.rollup, i.derived("gaps"), i.to_ms)
    return rows.withColumns(
        {c: F.to_json(c, snapshot.JSON) for c in ("top_articles", "per_minute")}
    )


@query
def snapshot_document(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return snapshot.to_document(snapshot.snapshot(i.edits, i.rollup, i.derived("gaps"), i.now_ms))


def _activity(lang: str, window: str) -> Query:
    def run(spark, sf_dir):
        i = Inputs(spark, sf_dir)
        request = activity_plan.parse_request(lang, window, LANGS)
        return activity_plan.activity(i.edits, i.rollup, i.pages, request, i.now_ms)

    return run


for _name in WINDOWS_S:
    register(f"activity_{_name}", _activity("all", _name))
register("activity_en_de_24h", _activity("de, en", "24h"))


@query
def ops_document(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    report = ops_report.ops_report(
        i.edits, i.derived("reconnects"), i.derived("samples"), i.derived("gaps"), i.costs, i.now_ms
    )
    return snapshot.to_document(report)
