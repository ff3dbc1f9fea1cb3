"""The hourly archive: Parquet under `dt=YYYY-MM-DD/hour=HH`, nine columns, zstd."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.functions.text import hour_of_path
from tidemark.functions.times import seconds
from tidemark.schema import ARCHIVE
from tidemark.sources.tables import Files

_NINE = [f.name for f in ARCHIVE.fields if f.name not in ("dt", "hour")]


def write_hours(edits: DataFrame, base: str) -> None:
    """Replace the archive of every hour in `edits`.

    Range-partitioned by time, so a busy hour is cut across tasks while its files, in name order,
    still hold its rows in (event_time, event_id) order. A quiet hour is normally one file.
    """
    (
        edits.select(*_NINE)
        .withColumns({"dt": F.to_date("event_time"), "hour": F.date_format("event_time", "HH")})
        .repartitionByRange("dt", "hour", "event_time", "event_id")
        .sortWithinPartitions("dt", "hour", "event_time", "event_id")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .partitionBy("dt", "hour")
        .parquet(base)
    )


def read_archive(
    spark: SparkSession, base: str, schema: StructType = ARCHIVE, days: Sequence[date] | None = None
) -> DataFrame:
    """Archived rows with a named schema, restricted to some days by partition pruning."""
    if not Files(spark).exists(base):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(base)
    return rows if days is None else rows.where(F.col("dt").isin(*days))


def existing_hours(spark: SparkSession, base: str, days: Sequence[date] | None = None) -> DataFrame:
    """Hours that have a file, from listing alone (of some days only): no content is read."""
    return listed_files(spark, base, days).select("hour_s").distinct()


def listed_files(spark: SparkSession, base: str, days: Sequence[date] | None = None) -> DataFrame:
    """(hour_s, path) of every file, from listing alone."""
    files = Files(spark)
    paths = [base] if days is None else [f"{base}/dt={day}" for day in days]
    paths = [p for p in paths if files.exists(p)]
    if not paths:
        return spark.createDataFrame([], "hour_s BIGINT, path STRING")
    listed = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.parquet")
        .option("recursiveFileLookup", "true")
        .load(paths)
        .select("path")
    )
    return listed.select(seconds(hour_of_path("path")).alias("hour_s"), "path").where("hour_s IS NOT NULL")


def file_states(spark: SparkSession, base: str, hours: Sequence[int]) -> DataFrame:
    """(hour_s, in_file, readable) of the listed hours that have files.

    A file is readable if it gives rows, all from inside its hour. Corrupt ones are passed over by the read and missed
    in the join with the listing, so one bad file fails no job.
    """
    if not hours:
        return spark.createDataFrame([], "hour_s BIGINT, in_file BIGINT, readable BOOLEAN")
    days = sorted({datetime.fromtimestamp(h, timezone.utc).date() for h in hours})
    listed = listed_files(spark, base, days).where(F.col("hour_s").isin(list(hours))).withColumn("file", F.element_at(F.split("path", "/"), -1))
    folders = [r["p"] for r in listed.select(F.expr("substring_index(path, '/', -3)").alias("p")).distinct().collect()]
    folders = sorted({f"{base}/{p.rsplit('/', 1)[0]}" for p in folders})
    if not folders:
        return spark.createDataFrame([], "hour_s BIGINT, in_file BIGINT, readable BOOLEAN")
    schema = StructType([ARCHIVE["event_time"], ARCHIVE["dt"], ARCHIVE["hour"]])
    rows = spark.read.schema(schema).option("basePath", base).option("ignoreCorruptFiles", "true").parquet(*folders)
    start = F.unix_seconds(F.to_timestamp(F.concat_ws(" ", F.col("dt").cast("string"), "hour"), "yyyy-MM-dd HH"))
    given = rows.select(start.alias("hour_s"), F.col("_metadata.file_name").alias("file"), seconds("event_time").alias("s")).groupBy("hour_s", "file").agg(
        F.count(F.lit(1)).alias("n"), ((F.min("s") >= F.col("hour_s")) & (F.max("s") < F.col("hour_s") + 3_600)).alias("inside")
    )
    beside = listed.select("hour_s", "file").join(given, ["hour_s", "file"], "left")
    return beside.groupBy("hour_s").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("in_file"), F.bool_and(F.coalesce("inside", F.lit(False))).alias("readable")
    )


def days_of(from_s: int, to_s: int) -> list[date]:
    """UTC days `[from, to)` touches."""
    first = datetime.fromtimestamp(from_s, timezone.utc).date()
    last = datetime.fromtimestamp(to_s - 1, timezone.utc).date()
    return [first + timedelta(days=i) for i in range((last - first).days + 1)]


def edits_by_day_and_lang(archived: DataFrame, first_day: date | None = None) -> DataFrame:
    """Edits and mean bot share by archived day and language."""
    rows = archived if first_day is None else archived.where(F.col("dt") >= F.lit(first_day))
    return (
        rows.groupBy("dt", "lang")
        .agg(F.count(F.lit(1)).alias("edits"), F.round(F.avg(F.col("is_bot").cast("int")), 3).alias("bot_share"))
        .orderBy("dt", "lang")
    )
