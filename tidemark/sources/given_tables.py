"""Edit-shaped inputs derived from the given `events` table.

Every derivation is a row-wise function of `events`, so its size grows with that table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_BASE = """
SELECT event_id, user_id, event_type, date_trunc('MILLISECOND', CAST(ts AS TIMESTAMP)) AS et,
  CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k,
  CASE WHEN event_type IN ('click','view') THEN 'en' WHEN event_type = 'error' THEN 'pt' ELSE 'de' END AS lang
FROM {events}
"""


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return spark.sql(_BASE, events=events)


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as stored edits."""
    return base(spark, sf_dir).selectExpr(
        "CAST(event_id AS STRING) AS event_id",
        "et AS event_time",
        "timestamp_millis(unix_millis(et) + 200 + (event_id * 7919) % 1800) AS ingested_at",
        "concat(lang, 'wiki') AS wiki",
        "lang",
        "CASE WHEN event_id % 10 = 0 THEN 'new' ELSE 'edit' END AS type",
        "CASE WHEN k % 10 < 7 THEN 0 ELSE k % 5 END AS namespace",
        "concat('Article ', CAST(user_id % 50 AS STRING)) AS title",
        "k % 5 = 0 AS is_bot",
        "concat('[{\"topic\":\"eqiad.x\",\"partition\":0,\"timestamp\":', CAST(unix_millis(et) AS STRING), '}]') AS sse_id",
        "event_id AS ingest_seq",
    )


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` in the order they arrive, by `position`; every twentieth id arrives a second time, 500 arrivals later."""
    once = base(spark, sf_dir).withColumn("position", F.expr("event_id * 2"))
    again = once.where("(position div 2) % 20 = 0").withColumn("position", F.col("position") + 1001)
    return once.unionByName(again)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as landed stream messages, some of them broken on purpose (by `event_id % 50`)."""
    return as_messages(arrivals(spark, sf_dir))


def as_messages(arrived: DataFrame) -> DataFrame:
    """The messages of these arrivals, row by row."""
    broken = arrived.selectExpr(
        "event_id",
        "position",
        "et",
        "event_id % 50 AS c",
        "concat('00000000-0000-4000-8000-', lpad(CAST(event_id AS STRING), 12, '0')) AS uid",
        "date_format(et, \"yyyy-MM-dd'T'HH:mm:ss.SSS\") AS dt_text",
        "CASE WHEN k % 10 < 7 THEN 0 ELSE k % 5 END AS ns",
        "concat('Article ', CAST(user_id % 50 AS STRING)) AS title",
        "CASE WHEN k % 5 = 0 THEN 'true' ELSE 'false' END AS bot",
        "CASE WHEN event_id % 50 = 4 THEN 'log' "
        "     WHEN event_id % 10 = 0 THEN 'new' ELSE 'edit' END AS change",
        "lang",
    )
    text = """
      CASE c WHEN 0 THEN '{not json' WHEN 1 THEN '[1,2]' ELSE concat(
        '{"meta":{"id":"', uid, '","domain":"', CASE c WHEN 2 THEN 'canary' ELSE concat(lang, '.wikipedia.org') END,
        '","dt":"', CASE c WHEN 9 THEN concat('2099', substring(dt_text, 5)) ELSE dt_text END,
        CASE c WHEN 8 THEN '' ELSE 'Z' END,
        '"},"wiki":"', CASE c WHEN 3 THEN 'frwiki' ELSE concat(lang, 'wiki') END,
        '","type":"', change, '","namespace":',
        CASE c WHEN 5 THEN 'true' WHEN 10 THEN '2147483648' ELSE CAST(ns AS STRING) END,
        ',"title":"', CASE c WHEN 7 THEN '' ELSE title END,
        '","bot":', CASE c WHEN 6 THEN '"false"' WHEN 11 THEN 'null' ELSE bot END, '}') END
    """
    return broken.selectExpr(
        "position",
        "concat('[{\"topic\":\"eqiad.x\",\"partition\":0,\"timestamp\":', CAST(unix_millis(et) AS STRING), '}]') AS sse_id",
        f"{text} AS data",
        "timestamp_millis(unix_millis(et) + 200 + (event_id * 7919) % 1800) AS received_at",
    )


def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hole around each `error` event: `k` seconds before it to `user_id % 60` seconds after."""
    return base(spark, sf_dir).where("event_type = 'error'").selectExpr(
        "et AS detected_at",
        "timestamp_millis(unix_millis(et) - k * 1000) AS gap_from",
        "timestamp_millis(unix_millis(et) + (user_id % 60) * 1000) AS gap_to",
        "CASE WHEN user_id % 2 = 0 THEN 'retention' ELSE 'outage' END AS reason",
    )


def reconnects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir).where("event_type = 'error'").selectExpr(
        "et AS at", "element_at(array('idle', 'eof', 'network', 'source_closed'), CAST(user_id % 4 AS INT) + 1) AS reason"
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A freshness sample at each event: its minute, its time, an age of 0 to 74 s or none."""
    return base(spark, sf_dir).selectExpr(
        "date_trunc('MINUTE', et) AS minute",
        "et AS sampled_at",
        "CASE WHEN user_id % 50 <> 0 THEN k * 0.75D END AS age_s",
    )


def cost_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cost answer at each event, some with two months, none, or no unit."""
    month = "'{\"Estimated\":', CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END, ',\"Total\":{\"UnblendedCost\":{\"Amount\":\"', CAST(event_id AS STRING), '.25\"', CASE WHEN user_id % 9 = 3 THEN '' ELSE ',\"Unit\":\"USD\"' END, '}}}'"
    return base(spark, sf_dir).selectExpr(
        "et AS fetched_at",
        "concat('{\"ResultsByTime\":[', CASE WHEN user_id % 9 = 0 THEN '' WHEN user_id % 9 = 1 THEN "
        f"concat({month}, ',', {month}) ELSE concat({month}) END, ']}}') AS response",
    )


def recorded_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archive ledger over the true hour counts: some hours short by one, some never recorded,
    and an older, larger record of each."""
    held = (
        base(spark, sf_dir)
        .groupBy(F.date_trunc("hour", "et").alias("hour"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("h", F.expr("unix_seconds(hour) div 3600"))
        .where("h % 13 <> 0")
    )
    newest = held.selectExpr(
        "hour", "n - CASE WHEN h % 11 = 0 THEN 1 ELSE 0 END AS rows", "hour + INTERVAL 2 HOURS AS written_at"
    )
    older = held.selectExpr("hour", "n + 5 AS rows", "hour + INTERVAL 1 HOUR AS written_at")
    return newest.unionByName(older)
