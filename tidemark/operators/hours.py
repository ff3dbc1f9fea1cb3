"""Hours as the unit of archiving: what raw rows hold, what files hold, what is due."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import HOUR_S
from tidemark.functions.times import at_ms, hour, ms, nanos, seconds
from tidemark.operators.windows import prune_days


def in_range(edits: DataFrame, from_s: int, to_s: int) -> DataFrame:
    """Rows in `[from, to)`, bounds at full timestamp precision so an hour's last second counts."""
    rows = prune_days(edits, from_s * 1000, to_s * 1000)
    return rows.where((F.col("event_time") >= at_ms(from_s * 1000)) & (F.col("event_time") < at_ms(to_s * 1000)))


def raw_span(edits: DataFrame) -> DataFrame:
    return edits.agg(
        ms(F.min("event_time")).alias("oldest_ms"),
        ms(F.max("event_time")).alias("newest_ms"),
        seconds(F.max("event_time")).alias("newest_s"),
        ms(F.max("ingested_at")).alias("ingested_ms"),
        F.count(F.lit(1)).alias("n"),
    )


def head(edits: DataFrame) -> DataFrame:
    """Newest event, last stored row, row count."""
    return edits.agg(
        ms(F.max("event_time")).alias("newest_ms"),
        ms(F.max("ingested_at")).alias("stored_ms"),
        F.count(F.lit(1)).alias("n"),
    )


def max_ingest_seq(edits: DataFrame) -> DataFrame:
    return edits.agg(F.max("ingest_seq").alias("seq"))


def ingest_mark(edits: DataFrame) -> DataFrame:
    """Where ingest stands: highest sequence number, last stored time, row count."""
    return edits.agg(
        F.coalesce(F.max("ingest_seq"), F.lit(0)).alias("seq"),
        F.coalesce(ms(F.max("ingested_at")), F.lit(0)).alias("last_ms"),
        F.count(F.lit(1)).alias("n"),
    )


def hour_counts(edits: DataFrame, from_s: int | None = None, to_s: int | None = None) -> DataFrame:
    rows = edits if from_s is None else in_range(edits, from_s, to_s)
    return rows.groupBy(seconds(hour("event_time")).alias("hour_s")).agg(F.count(F.lit(1)).alias("rows"))


def recorded_counts(archive_hours: DataFrame, from_s: int | None = None, to_s: int | None = None) -> DataFrame:
    """What each hour's file holds: the newest record wins, a tie goes to the larger count."""
    rows = archive_hours
    if from_s is not None:
        rows = rows.where((F.col("hour") >= at_ms(from_s * 1000)) & (F.col("hour") < at_ms(to_s * 1000)))
    return rows.groupBy(seconds("hour").alias("hour_s")).agg(
        F.max_by("rows", F.struct("written_at", "rows")).alias("rows")
    )


def filled_hours(pages_filled: DataFrame) -> DataFrame:
    return pages_filled.select(seconds("hour").alias("hour_s")).distinct()


def hour_spine(spark: SparkSession, from_s: int, to_s: int) -> DataFrame:
    """Every hour of `[from, to)`."""
    return spark.range(from_s, to_s, HOUR_S).select(F.col("id").alias("hour_s"))


def hours_frame(spark: SparkSession, hours: list[int]) -> DataFrame:
    """A literal list of hours as rows."""
    return spark.createDataFrame([(int(h),) for h in hours], "hour_s BIGINT")


def missing_hours(expected: DataFrame, present: DataFrame) -> DataFrame:
    return expected.select("hour_s").join(present.select("hour_s"), "hour_s", "left_anti")


def due_hours(raw: DataFrame, recorded: DataFrame, unreadable: DataFrame | None = None) -> DataFrame:
    """Hours whose raw rows outnumber their file's (none = 0), except unreadable files' hours."""
    in_file = recorded.select("hour_s", F.col("rows").alias("in_file"))
    due = (
        raw.join(in_file, "hour_s", "left")
        .withColumn("in_file", F.coalesce("in_file", F.lit(0)))
        .where(F.col("rows") > F.col("in_file"))
    )
    return due if unreadable is None else due.join(unreadable.select("hour_s"), "hour_s", "left_anti")


def short_hours(recorded: DataFrame, staged: DataFrame) -> DataFrame:
    """Hours whose staged edits differ from what their file is recorded to hold."""
    held = staged.select("hour_s", F.col("edits").alias("staged_edits"))
    return (
        recorded.join(held, "hour_s", "left")
        .withColumn("staged_edits", F.coalesce("staged_edits", F.lit(0)))
        .where(F.col("staged_edits") != F.col("rows"))
    )


def file_check(archived: DataFrame) -> DataFrame:
    """Rows per archived hour, and whether all of them lie inside the hour their path names."""
    start = F.unix_seconds(F.to_timestamp(F.concat_ws(" ", F.col("dt").cast("string"), "hour"), "yyyy-MM-dd HH"))
    return (
        archived.groupBy("dt", "hour")
        .agg(F.count(F.lit(1)).alias("rows"), F.min("event_time").alias("lo"), F.max("event_time").alias("hi"))
        .select(
            start.alias("hour_s"),
            "rows",
            ((seconds("lo") >= start) & (seconds("hi") < start + HOUR_S)).alias("inside"),
        )
    )


def restored_rows(archived: DataFrame) -> DataFrame:
    """Archive rows as raw rows: no stream id, ingest order from when they were first stored."""
    return archived.drop("hour").withColumns(
        {"sse_id": F.lit(""), "ingest_seq": nanos("ingested_at"), "dt": F.to_date("event_time")}
    )


def month_pieces(days: DataFrame) -> DataFrame:
    """A `[first_day, end_day)` range split at month starts, one row a piece."""
    months = F.explode(
        F.sequence(F.trunc("first_day", "MM"), F.trunc(F.date_sub("end_day", 1), "MM"), F.expr("INTERVAL 1 MONTH"))
    )
    return days.where("first_day < end_day").withColumn("m", months).select(
        F.greatest("first_day", "m").alias("piece_from"),
        F.least("end_day", F.add_months("m", 1)).alias("piece_to"),
    )
