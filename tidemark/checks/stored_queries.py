"""Registered queries that run jobs over stored tables: streaming ingest, archive and upkeep.

Each writes what it needs from the given tables under the shared work folder and returns what the
job left there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.checks.queries import Inputs, query, register
from tidemark.config import HOUR_S, LANGS, WINDOWS_S, Settings
from tidemark.functions import times
from tidemark.operators import hours, lag, ledger, page_tree, rollups, windows
from tidemark.plans import logs, page_sets, reconcile, resume, upkeep
from tidemark.plans.archive import Archiver, archive_status
from tidemark.plans.rebuild import rebuild
from tidemark.plans.restore import restore
from tidemark.session import work_path
from tidemark.sources import given_tables as given
from tidemark.sources.archive import days_of, edits_by_day_and_lang, existing_hours, read_archive, write_hours
from tidemark.sources.stream import landed_files
from tidemark.sources.tables import Tables
from tidemark.streaming.ingest import Ingest
from tidemark.streaming.restart import pick_up, resume_ingest

_done: dict[tuple[str, str, str], str] = {}

LANDINGS = 3
FILES_PER_LANDING = 4  # at least
MESSAGES_PER_FILE = 50_000  # a file is read by one task, so larger inputs land in more files, not in larger ones
QUIET_MS = 120_000


def _once(spark: SparkSession, sf_dir: str, kind: str, build) -> str:
    """A path built once per session and input folder."""
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key not in _done:
        path = work_path(spark, kind)
        build(path)
        _done[key] = path
    return _done[key]


def files_for(messages: int) -> int:
    return max(FILES_PER_LANDING, -(-messages // MESSAGES_PER_FILE))


def _land_part(arrivals: DataFrame, path: str, files: int) -> None:
    """Dealt evenly before the texts are made, while rows are narrow."""
    given.as_messages(arrivals.repartition(files, "position")).write.mode("append").parquet(path)


def _extent(arrivals: DataFrame) -> tuple[int, int]:
    """Highest position and number of arrivals."""
    found = arrivals.agg(F.max("position").alias("last"), F.count(F.lit(1)).alias("n")).first()
    return found["last"], found["n"]


def _land(spark: SparkSession, sf_dir: str, path: str) -> int:
    """Messages as a connector lands them: a few times, in arrival order. Returns the files of a landing."""
    arrivals = given.arrivals(spark, sf_dir)
    last, n = _extent(arrivals)
    files = files_for(-(-n // LANDINGS))
    for i in range(LANDINGS):
        part = F.expr(f"position * {LANDINGS} div {last + 1}") == i
        _land_part(arrivals.where(part), path, files)
    return files


def _streamed(spark: SparkSession, sf_dir: str) -> Tables:
    def build(path: str) -> None:
        files = _land(spark, sf_dir, f"{path}/landed")
        source = landed_files(spark, f"{path}/landed", max_files=files)
        run = Ingest(Tables(spark, f"{path}/tables")).start(source, f"{path}/checkpoint", available_now=True)
        run.awaitTermination()

    return Tables(spark, f"{_once(spark, sf_dir, 'stream', build)}/tables")


def _merged(tables: Tables) -> DataFrame:
    counts = rollups.merge_counts(tables.read("edits_per_minute"))
    return counts.withColumn("minute_s", times.seconds("minute")).drop("minute")


@query
def stream_edits(spark, sf_dir):
    return _streamed(spark, sf_dir).read("edits").select(
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
def stream_rollup(spark, sf_dir):
    return _merged(_streamed(spark, sf_dir))


@query
def stream_pages(spark, sf_dir):
    merged = rollups.merge_pages(_streamed(spark, sf_dir).read("pages_per_minute"))
    return merged.withColumn("minute_s", times.seconds("minute")).drop("minute")


@query
def stream_outcomes(spark, sf_dir):
    return _streamed(spark, sf_dir).read("outcomes").groupBy("outcome").agg(F.sum("n").alias("n"))


def _resumed(spark: SparkSession, sf_dir: str) -> Tables:
    """A third of the messages by one checkpoint, then all that landed by a fresh one that begins at the bookmark."""
    def build(path: str) -> None:
        tables, arrivals = Tables(spark, f"{path}/tables"), given.arrivals(spark, sf_dir)
        last, n = _extent(arrivals)
        for k, part in enumerate((F.col("position") <= last / 3, F.col("position") > last / 3)):
            _land_part(arrivals.where(part), f"{path}/landed", files_for(n * (k + 1) // 3))
            if k == 0:
                Ingest(tables).start(landed_files(spark, f"{path}/landed"), f"{path}/first", available_now=True).awaitTermination()
        now_ms = tables.watermark_ms() + QUIET_MS
        resume_ingest(tables, f"{path}/landed", f"{path}/second", now_ms, available_now=True).awaitTermination()

    return Tables(spark, f"{_once(spark, sf_dir, 'resumed', build)}/tables")


@query
def resumed_edits(spark, sf_dir):
    """What is stored after a restart with a fresh checkpoint: every message once."""
    return _resumed(spark, sf_dir).read("edits").select("event_id", times.ms("event_time").alias("event_ms"), "lang", "title", "sse_id")


@query
def resume_gap_recorded(spark, sf_dir):
    """The one gap left by two starts after the source has forgotten the newest event."""
    path, now_ms = work_path(spark, "resume-gap"), Inputs(spark, sf_dir).to_ms + 8 * 86_400_000
    tables = Tables(spark, f"{path}/tables")
    tables.write_once("edits", given.edits(spark, sf_dir).withColumn("dt", F.to_date("event_time")), "all")
    for k in range(2):
        pick_up(tables, f"{path}/checkpoint-{k}", now_ms + k * 60_000)
    return tables.read("ingest_gaps").select(
        times.ms("detected_at").alias("detected_ms"), times.ms("gap_from").alias("gap_from_ms"), times.ms("gap_to").alias("gap_to_ms"), "reason"
    )


# --- a store filled from the given tables --------------------------------------------------------


def _fill(tables: Tables, i: Inputs, rollup: DataFrame | None = None) -> Tables:
    tables.write_once("edits", i.edits.withColumn("dt", F.to_date("event_time")), "given")
    rollup = rollups.per_minute(tables.read("edits")) if rollup is None else rollup
    tables.write_once("edits_per_minute", rollups.with_month(rollup), "given")
    return tables


def _archived(spark: SparkSession, sf_dir: str) -> str:
    return _once(spark, sf_dir, "archive", lambda path: write_hours(given.edits(spark, sf_dir), path))


@query
def archive_by_day_lang(spark, sf_dir):
    table = edits_by_day_and_lang(read_archive(spark, _archived(spark, sf_dir)))
    return table.withColumn("dt", F.col("dt").cast("string"))


@query
def archive_rows(spark, sf_dir):
    rows = read_archive(spark, _archived(spark, sf_dir))
    return rows.select(
        *[c for c in rows.columns if c not in ("event_time", "ingested_at", "dt")],
        times.ms("event_time").alias("event_ms"),
        times.ms("ingested_at").alias("ingested_ms"),
        F.col("dt").cast("string").alias("dt"),
    )


@query
def archive_files(spark, sf_dir):
    """Hours found by listing, beside what their files hold."""
    base = _archived(spark, sf_dir)
    return existing_hours(spark, base).join(hours.file_check(read_archive(spark, base)), "hour_s", "left")


@query
def archive_run(spark, sf_dir):
    """One archive pass over an empty archive: every finished hour of the last week."""
    i = Inputs(spark, sf_dir)
    path = work_path(spark, "archive-run")
    tables = _fill(Tables(spark, f"{path}/tables"), i)
    run = Archiver(tables, f"{path}/archive").run_once(i.to_ms + QUIET_MS)
    rows = spark.createDataFrame([(r.hour_s, r.result) for r in run], "hour_s BIGINT, result STRING")
    recorded = hours.recorded_counts(tables.read("archive_hours"))
    filled = hours.filled_hours(tables.read("pages_filled")).withColumn("filled", F.lit(True))
    return rows.join(recorded, "hour_s", "left").join(filled, "hour_s", "left")


@query
def archive_page_sets(spark, sf_dir):
    """Page sets filled from the archive for the days they are kept."""
    i = Inputs(spark, sf_dir)
    tables = Tables(spark, work_path(spark, "page-sets"))
    page_sets.fill_missing(tables, _archived(spark, sf_dir), i.to_ms + QUIET_MS)
    return rollups.pages_per_hour(rollups.merge_pages(tables.read("pages_per_minute")))


@query
def rebuild_swap(spark, sf_dir):
    """A drifted pre-aggregate after its days are rebuilt from the archive."""
    i = Inputs(spark, sf_dir)
    tables = _fill(Tables(spark, work_path(spark, "rebuild")), i, i.drifted)
    span = hours.raw_span(i.edits).first()
    days = days_of(span["oldest_ms"] // 1000, span["newest_s"] + 1)
    base, now_ms = _archived(spark, sf_dir), i.to_ms + QUIET_MS
    for first in range(0, len(days), 31):  # one rebuild covers at most 31 days
        piece = days[first : first + 31]
        end = times.day_of_ms((times.day_start_of(piece[-1]) + 24 * HOUR_S) * 1000)
        rebuild(tables, base, piece[0], end, now_ms, allow_missing=True)
    return _merged(tables)


@query
def reconcile_job(spark, sf_dir):
    """A drifted pre-aggregate after the repair job."""
    i = Inputs(spark, sf_dir)
    tables = _fill(Tables(spark, work_path(spark, "reconcile")), i, i.drifted)
    now_ms = i.now_ms
    settings = Settings(quiet_s=10)
    reconcile.repair(tables, reconcile.find_mismatches(tables, now_ms, settings), now_ms, settings)
    return _merged(tables)


def _restored(spark: SparkSession, sf_dir: str) -> Tables:
    def build(path: str) -> None:
        restore(Tables(spark, path), _archived(spark, sf_dir), Inputs(spark, sf_dir).to_ms + QUIET_MS)

    return Tables(spark, _once(spark, sf_dir, "restore", build))


@query
def restored_minutes(spark, sf_dir):
    return _merged(_restored(spark, sf_dir))


@query
def restored_edits(spark, sf_dir):
    rows = _restored(spark, sf_dir).read("edits")
    return rows.select("event_id", "sse_id", "ingest_seq", times.ms("event_time").alias("event_ms"), "title")


@query
def compacted_rollup(spark, sf_dir):
    """Partials of three writes folded into one file set a month."""
    i = Inputs(spark, sf_dir)
    tables = Tables(spark, work_path(spark, "compact"))
    for part in range(3):
        some = i.edits.where(F.expr("ingest_seq div 1000 % 3") == part)
        tables.write_once("edits_per_minute", rollups.with_month(rollups.per_minute(some)), f"w{part}")
    upkeep.compact_all(tables, "edits_per_minute", tables.partitions("edits_per_minute"), i.now_ms)
    rows = tables.read("edits_per_minute")  # read as stored: already one row a minute
    return rows.select(times.seconds("minute").alias("minute_s"), "lang", "edits", "bot_edits")


@query
def retained_edits(spark, sf_dir):
    """What is left of each day after retention."""
    i = Inputs(spark, sf_dir)
    tables = _fill(Tables(spark, work_path(spark, "retention")), i)
    upkeep.expire(tables, i.now_ms)
    return tables.read("edits").groupBy(F.col("dt").cast("string").alias("dt")).agg(F.count(F.lit(1)).alias("rows"))


@query
def reconnects_recorded_twice(spark, sf_dir):
    """A sealed batch of reconnects recorded again under its token is still one batch."""
    tables = Tables(spark, work_path(spark, "reconnects"))
    for _ in range(2):
        logs.record_reconnects(tables, given.reconnects(spark, sf_dir), "batch-1")
    rows = tables.read("ingest_reconnects")
    return rows.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


# --- restores that were cut off, folded or damaged -------------------------------------------------


def _restored_edits(tables: Tables) -> DataFrame:
    return tables.read("edits").select("event_id", "sse_id", "ingest_seq", times.ms("event_time").alias("event_ms"), "title")


@query
def restore_resumed(spark, sf_dir):
    """Raw rows after a restore whose newest day lost every third hour and a row of each other one, and came back."""
    i, base = Inputs(spark, sf_dir), _archived(spark, sf_dir)
    tables = Tables(spark, work_path(spark, "restore-resumed"))
    restore(tables, base, i.to_ms + QUIET_MS)
    day = tables.partitions("edits")[-1]
    held = tables.read("edits").where(F.col("dt") == F.lit(day).cast("date"))
    left = held.where(F.hour("event_time") % 3 != 0).withColumn("nth", F.expr("row_number() OVER (PARTITION BY date_trunc('hour', event_time) ORDER BY event_id)"))
    tables.replace("edits", [day], left.where("nth > 1").drop("nth", "token"), "restored")
    restore(tables, base, i.to_ms + QUIET_MS)
    return _restored_edits(tables)


def _restored_folded(spark: SparkSession, sf_dir: str) -> Tables:
    def build(path: str) -> None:
        i, base, tables = Inputs(spark, sf_dir), _archived(spark, sf_dir), Tables(spark, path)
        now_ms = i.to_ms + QUIET_MS
        restore(tables, base, now_ms)
        for name in ("edits", "edits_per_minute"):
            upkeep.compact_all(tables, name, tables.partitions(name), now_ms)
        day = tables.partitions("edits")[-1]
        lost = tables.read("edits").where((F.col("dt") == F.lit(day).cast("date")) & (F.hour("event_time") % 2 == 0))
        tables.replace("edits", [day], lost.drop("token"), "folded")
        month = tables.partitions("edits_per_minute")[-1]
        kept = tables.read("edits_per_minute").where((F.col("month") == int(month)) & (F.hour("minute") % 5 != 0))
        tables.replace("edits_per_minute", [month], kept.drop("token"), "folded")
        restore(tables, base, now_ms)

    return Tables(spark, _once(spark, sf_dir, "restore-folded", build))


@query
def restore_after_compaction(spark, sf_dir):
    """Raw rows after a restore was folded, lost half of a day's hours and came back."""
    return _restored_edits(_restored_folded(spark, sf_dir))


@query
def restored_counts_after_compaction(spark, sf_dir):
    """Counts of the same store, of which a fifth of the newest month's hours were lost as well."""
    return _merged(_restored_folded(spark, sf_dir))


# --- a batch that is replayed after a rewrite ------------------------------------------------------


def _two_batches(spark: SparkSession, sf_dir: str, kind: str) -> tuple[Tables, Ingest, DataFrame]:
    """Messages ingested as two batches, the second one not committed yet."""
    messages = given.messages(spark, sf_dir)
    cut = messages.agg(F.expr("max(position) div 2")).first()[0]
    tables = Tables(spark, work_path(spark, kind))
    ingest, second = Ingest(tables), messages.where(F.col("position") > cut)
    ingest.write(messages.where(F.col("position") <= cut), "run", 0)
    ingest.write(second, "run", 1)
    return tables, ingest, second


@query
def repair_then_replay(spark, sf_dir):
    """Counts after the last batch's were lost in part, its minutes were repaired, and the batch was replayed."""
    tables, ingest, second = _two_batches(spark, sf_dir, "repair-replay")
    month = tables.partitions("edits_per_minute")[-1]
    kept = tables.read("edits_per_minute").where((F.col("month") == int(month)) & (F.minute("minute") % 2 == 0))
    tables.replace("edits_per_minute", [month], kept.drop("token"), "damaged")
    now_ms = tables.watermark_ms() + 3_600_000
    reconcile.repair(tables, reconcile.find_mismatches(tables, now_ms), now_ms)
    ingest.write(second, "run", 1)
    return _merged(tables)


@query
def delete_then_replay(spark, sf_dir):
    """Edits after an article's rows of the newest day were deleted and the batch that wrote them was replayed."""
    tables, ingest, second = _two_batches(spark, sf_dir, "delete-replay")
    now_ms = tables.watermark_ms() + 3_600_000
    upkeep.delete_rows(tables, "edits", tables.partitions("edits")[-1], F.col("title").isin("Article 7", "Article 8"), now_ms)
    ingest.write(second, "run", 1)
    return tables.read("edits").select("event_id", times.ms("event_time").alias("event_ms"), "lang", "title", "sse_id")


@query
def seam_restart(spark, sf_dir):
    """Edits after a second run, from a new checkpoint, was sent everything again."""
    messages = given.messages(spark, sf_dir)
    cut = messages.agg(F.expr("max(position) * 3 div 4")).first()[0]
    tables = Tables(spark, work_path(spark, "seam-restart"))
    Ingest(tables).write(messages.where(F.col("position") <= cut), "one", 0)
    Ingest(tables).write(messages, "two", 0)
    return tables.read("edits").select("event_id", times.ms("event_time").alias("event_ms"), "lang", "title", "namespace", "is_bot")


# --- answers from the ledger of writes -------------------------------------------------------------

WRITES = 5


def _written_in_parts(spark: SparkSession, sf_dir: str) -> Tables:
    """A store of several writes, one of its days folded."""
    def build(path: str) -> None:
        i, tables = Inputs(spark, sf_dir), Tables(spark, path)
        edits = i.edits.withColumn("dt", F.to_date("event_time"))
        last = edits.agg(F.max("ingest_seq")).first()[0]
        for part in range(WRITES):
            tables.write_once("edits", edits.where(F.expr(f"ingest_seq * {WRITES} div {last + 1}") == part), f"run-{part:09d}")
        tables.write_once("edits_per_minute", rollups.with_month(i.rollup), "given")
        upkeep.compact(tables, "edits", tables.partitions("edits")[0], i.now_ms)

    return Tables(spark, _once(spark, sf_dir, "parts", build))


@query
def ledger_head(spark, sf_dir):
    return ledger.head(_written_in_parts(spark, sf_dir).ledger())


@query
def ledger_span(spark, sf_dir):
    return ledger.raw_span(_written_in_parts(spark, sf_dir).ledger())


@query
def ledger_bookmark(spark, sf_dir):
    return ledger.latest_bookmark(_written_in_parts(spark, sf_dir).ledger())


@query
def ledger_max_seq(spark, sf_dir):
    return ledger.max_ingest_seq(_written_in_parts(spark, sf_dir).ledger())


@query
def ledger_resume(spark, sf_dir):
    """Where ingest picks up, without a look at raw rows."""
    tables = _written_in_parts(spark, sf_dir)
    return resume.resume_state(None, tables.read("edits_per_minute"), Inputs(spark, sf_dir).now_ms, ledger=tables.ledger())


@query
def ledger_stored_lag(spark, sf_dir):
    """Lag of the rows stored in the last hour: only writes that hold some are opened."""
    now_ms = Inputs(spark, sf_dir).now_ms
    return lag.stored_lag(_written_in_parts(spark, sf_dir).stored_since(now_ms - 3_600_000), now_ms)


# --- windows over the tree of page sets ------------------------------------------------------------


def _page_store(spark: SparkSession, sf_dir: str) -> Tables:
    """Counts and page sets of several writes; some days folded."""
    def build(path: str) -> None:
        i, tables = Inputs(spark, sf_dir), Tables(spark, path)
        last = i.edits.agg(F.max("ingest_seq")).first()[0]
        for part in range(WRITES):
            page_sets.add_pages(tables, i.edits.where(F.expr(f"ingest_seq * {WRITES} div {last + 1} IN ({part}, {part + 1})")), f"w{part}")
        tables.write_once("edits_per_minute", rollups.with_month(i.rollup), "given")
        days = tables.partitions("pages_per_day")[::3]
        for name in ("pages_per_minute", "pages_per_hour", "pages_per_day"):
            upkeep.compact_all(tables, name, days, i.now_ms)

    return Tables(spark, _once(spark, sf_dir, "pages", build))


def _from_tree(name: str):
    def run(spark, sf_dir):
        tables, to_ms = _page_store(spark, sf_dir), Inputs(spark, sf_dir).to_ms
        pages = page_tree.pages_in_window(tables.page_sets(), to_ms, WINDOWS_S[name], LANGS)
        return windows.totals_with_pages(tables.read("edits_per_minute"), pages, to_ms, WINDOWS_S[name], LANGS)

    return run


for _name in ("24h", "3d", "7d"):
    register(f"window_from_tree_{_name}", _from_tree(_name))


@query
def page_tree_hours(spark, sf_dir):
    """Members of every hour's set."""
    rows = _page_store(spark, sf_dir).page_sets().hours
    return rows.select(times.seconds("hour").alias("hour_s"), *page_tree.MEMBER).distinct()


@query
def page_tree_days(spark, sf_dir):
    rows = _page_store(spark, sf_dir).page_sets().days
    return rows.select(F.col("dt").cast("string").alias("dt"), *page_tree.MEMBER).distinct()


# --- archive passes over what is there already -----------------------------------------------------


@query
def archive_adopted(spark, sf_dir):
    """A pass of a store that has no record of files someone else wrote: those of every third hour lack."""
    i = Inputs(spark, sf_dir)
    path = work_path(spark, "archive-adopted")
    tables = _fill(Tables(spark, f"{path}/tables"), i)
    write_hours(i.edits.where(F.expr("unix_seconds(event_time) div 3600 % 3 <> 0")), f"{path}/archive")
    run = Archiver(tables, f"{path}/archive").run_once(i.to_ms + QUIET_MS)
    rows = spark.createDataFrame([(r.hour_s, r.result, r.rows) for r in run], "hour_s BIGINT, result STRING, rows BIGINT")
    return rows.join(hours.recorded_counts(tables.read("archive_hours")).withColumnRenamed("rows", "recorded"), "hour_s", "left")


@query
def archive_late_fill(spark, sf_dir):
    """Pages per hour after a pass found every hour archived and no page set filled."""
    i = Inputs(spark, sf_dir)
    path = work_path(spark, "archive-late")
    tables = _fill(Tables(spark, f"{path}/tables"), i)
    archiver, now_ms = Archiver(tables, f"{path}/archive"), i.to_ms + QUIET_MS
    archiver.run_once(now_ms)
    for name in ("pages_filled", "pages_per_minute", "pages_per_hour", "pages_per_day"):
        tables.files.remove(tables.path(name))
    archiver.run_once(now_ms + 1)
    return rollups.pages_per_hour(rollups.merge_pages(tables.read("pages_per_minute")))


@query
def archive_states(spark, sf_dir):
    """What a pass would decide where files of every third hour lack and every fourth has a record that is short by one."""
    i = Inputs(spark, sf_dir)
    path = work_path(spark, "archive-states")
    tables = _fill(Tables(spark, f"{path}/tables"), i)
    write_hours(i.edits.where(F.expr("unix_seconds(event_time) div 3600 % 3 <> 0")), f"{path}/archive")
    counts = hours.hour_counts(i.edits).where(F.expr("hour_s div 3600 % 4 = 0")).withColumn("rows", F.col("rows") - 1)
    logs.record_archived(tables, counts, i.now_ms, "short")
    return archive_status(tables, f"{path}/archive", i.to_ms + QUIET_MS)
