"""Every landed message gets exactly one outcome, whatever JSON it holds.

The message is parsed once into a VARIANT, whose type tests tell missing from null and 1 from
1.0 or true. Rules are one ordered CASE, so a message never fails a job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import (
    DEFAULTS,
    FIRST_YEAR,
    INT32_MAX,
    INT32_MIN,
    LAST_YEAR,
    MAX_FUTURE_S,
    MAX_TITLE_BYTES,
    Settings,
)
from tidemark.functions.text import lang_of
from tidemark.functions.times import at_ms

# The text forms accepted for ids and times.
PLAIN_UUID = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
HEX32 = "^[0-9a-f]{32}$"
PLAIN_TIME = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?Z$"
ISO_WITH_OFFSET = (
    r"^(\d{4})-?(\d{2})-?(\d{2})[^0-9](\d{2})(?::?(\d{2}))?(?::?(\d{2}))?(?:[.,](\d+))?"
    r"(Z|[+-]\d{2}(?::?\d{2}(?::?\d{2})?)?)$"
)

# One cast takes every field out of the message; a cast of anything but an object gives NULL.
EVENT = "struct<meta:variant,wiki:variant,type:variant,namespace:variant,title:variant,bot:variant>"
META = "struct<id:variant,dt:variant,domain:variant>"


def _uuid(text: Column) -> Column:
    """Canonical lower-case UUID from its accepted spellings (braces, urn prefix, no hyphens)."""
    digits = F.lower(F.regexp_replace(F.regexp_replace(text, "urn:|uuid:", ""), "^[{}]+|[{}]+$|-", ""))
    hyphenated = F.regexp_replace(digits, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    return F.when(text.rlike(PLAIN_UUID), text).when(digits.rlike(HEX32), hyphenated)


def _instant(text: Column) -> Column:
    """The instant an ISO-8601 text with an offset names; NULL for anything else."""
    spread = F.regexp_replace(text, ISO_WITH_OFFSET, "$1-$2-$3T$4:$5:$6.$7$8")
    padded = F.regexp_replace(spread, r":(?=[:.])", ":00")
    return F.when(text.rlike(PLAIN_TIME), F.try_to_timestamp(text)).when(
        text.rlike(ISO_WITH_OFFSET), F.try_to_timestamp(padded)
    )


def _strict(field: str, kind: str) -> Column:
    """The field's value if its JSON type is exactly `kind`, else NULL."""
    value = F.try_variant_get(field, "$", kind)
    return F.when(F.schema_of_variant(field) == kind.upper(), value)


def _settle(rows: DataFrame, **columns: Column) -> DataFrame:
    """Add columns as values rather than expressions.

    They pass through a generator of one element, so a later filter on anything built from them
    reads the value; pushed below a plain projection it would repeat the parsing per use.
    """
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def _typed(messages: DataFrame) -> DataFrame:
    """One parse per message, then each field as a value of its own type or NULL."""
    rows = messages.withColumn("event", F.try_variant_get(F.try_parse_json("data"), "$", EVENT)).drop("data")
    rows = rows.withColumn("meta", F.try_variant_get("event.meta", "$", META))
    rows = _settle(
        rows,
        is_event=F.col("meta").isNotNull(),
        domain=_strict("meta.domain", "string"),
        raw_id=_strict("meta.id", "string"),
        raw_dt=_strict("meta.dt", "string"),
        wiki=_strict("event.wiki", "string"),
        type=_strict("event.type", "string"),
        title=_strict("event.title", "string"),
        namespace=_strict("event.namespace", "bigint"),
        bot=_strict("event.bot", "boolean"),
        has_bot=F.col("event.bot").isNotNull(),
    ).drop("event", "meta")
    return _settle(rows, event_id=_uuid(F.col("raw_id")), instant=_instant(F.col("raw_dt")))


def classify(
    messages: DataFrame, settings: Settings = DEFAULTS, floor_ms: int | None = None
) -> DataFrame:
    """Landed messages -> the edit's columns plus `outcome`, one row a message.

    "Too far ahead" is judged against each message's own `received_at`, so a replay of the batch
    gives the same answer. Empty messages are keep-alives and give no row.
    """
    year = F.substring("raw_dt", 1, 4).try_cast("int")
    limit = F.col("received_at") + F.expr(f"INTERVAL {MAX_FUTURE_S} SECONDS")
    before_floor = F.lit(False) if floor_ms is None else F.col("instant") < at_ms(floor_ms)
    sound = (
        F.col("title").isNotNull()
        & F.col("namespace").between(INT32_MIN, INT32_MAX)
        & (F.col("bot").isNotNull() | ~F.col("has_bot"))
        & F.col("event_id").isNotNull()
        & F.col("instant").isNotNull()
        & F.octet_length("title").between(1, MAX_TITLE_BYTES)
        & year.between(FIRST_YEAR, LAST_YEAR)
    )

    outcome = (
        F.when(~F.col("is_event"), "malformed")
        .when(F.col("domain") == "canary", "canary")
        .when(F.col("wiki").isNull(), "malformed")
        .when(~F.col("wiki").isin(*settings.wikis), "other_wiki")
        .when(F.col("type").isNull(), "malformed")
        .when(~F.col("type").isin(*settings.types), "other_type")
        .when(~F.coalesce(sound, F.lit(False)), "malformed")
        .when(F.col("instant") > limit, "future")
        .when(F.coalesce(F.col("sse_id"), F.lit("")) == "", "malformed")
        .when(before_floor, "before_floor")
        .otherwise("kept")
    )
    return _typed(messages.where("data <> ''")).select(
        "position",
        outcome.alias("outcome"),
        "event_id",
        F.date_trunc("MILLISECOND", "instant").alias("event_time"),
        F.date_trunc("MILLISECOND", "received_at").alias("ingested_at"),
        "wiki",
        lang_of("wiki").alias("lang"),
        "type",
        F.col("namespace").try_cast("int").alias("namespace"),
        "title",
        F.coalesce("bot", F.lit(False)).alias("is_bot"),
        "sse_id",
    )


def count_outcomes(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))
