"""Edits and freshness samples at scale for measuring, generated on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import DAY_S, LANGS


def synthetic_edits(spark: SparkSession, days: int, rate: int, end_ms: int) -> DataFrame:
    """Exactly `days` of edits at `rate` a second, ending at `end_ms`.

    en 65 %, pt 16 %, de 19 %; one in five a bot, one in ten a new page; a few titles are hot and
    most are edited once.
    """
    start_ms = end_ms - days * DAY_S * 1000
    rows = spark.range(days * DAY_S * rate).select(
        "id",
        F.pmod(F.xxhash64("id"), F.lit(2**62)).alias("h"),
        F.timestamp_millis(F.lit(start_ms) + F.expr(f"id * 1000 div {rate}")).alias("t"),
    )
    pick = F.lit(1) + (F.col("h") % 100 >= 65).cast("int") + (F.col("h") % 100 >= 81).cast("int")
    rows = rows.withColumn("lang", F.element_at(F.array(*[F.lit(x) for x in LANGS]), pick))
    spread = F.expr("(h % 1000003) div (1 + shiftright(h, 40) % 64)")
    at_ms = F.unix_millis("t").cast("string")
    sse_id = F.format_string(
        '[{"topic":"eqiad.x","partition":0,"timestamp":%s},{"topic":"codfw.x","partition":0,"timestamp":%s}]',
        at_ms,
        (F.unix_millis("t") - 1500).cast("string"),
    )
    return rows.select(
        F.regexp_replace(
            F.md5(F.col("id").cast("string")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"
        ).alias("event_id"),
        F.col("t").alias("event_time"),
        F.timestamp_millis(F.unix_millis("t") + 200 + F.col("h") % 1800).alias("ingested_at"),
        F.concat("lang", F.lit("wiki")).alias("wiki"),
        "lang",
        F.when(F.col("h") % 10 == 0, "new").otherwise("edit").alias("type"),
        F.when(F.col("h") % 10 < 7, 0).otherwise(F.col("h") % 5).cast("int").alias("namespace"),
        F.concat(F.lit("Article "), spread.cast("string")).alias("title"),
        (F.col("h") % 5 == 0).alias("is_bot"),
        sse_id.alias("sse_id"),
        (F.unix_micros("t") * 1000 + F.col("id") % 1000).alias("ingest_seq"),
        F.to_date("t").alias("dt"),
    )


def synthetic_samples(spark: SparkSession, minutes: int, end_ms: int) -> DataFrame:
    """One freshness sample a minute before `end_ms`; one in 500 is stale."""
    last = end_ms // 60_000 * 60
    return spark.range(minutes).select(
        F.timestamp_seconds(F.lit(last) - (F.col("id") + 1) * 60).alias("minute"),
        F.timestamp_millis((F.lit(last) - (F.col("id") + 1) * 60) * 1000 + 5).alias("sampled_at"),
        F.when(F.col("id") % 500 == 0, 90.0).otherwise(2.5).alias("age_s"),
    )
