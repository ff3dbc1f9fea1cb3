"""A stream id (JSON list of topic positions) reduced to one position per stream."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.config import PLAUSIBLE_MS_FROM, PLAUSIBLE_MS_TO
from tidemark.functions.times import iso


def _kind(value: Column, path: str) -> Column:
    """The JSON type at `path`; NULL where the field is missing."""
    return F.schema_of_variant(F.try_variant_get(value, path, "variant"))


def _whole(value: Column, path: str) -> Column:
    """A JSON whole number; NULL for true, 1.0, "1" and anything beyond 64 bits."""
    return F.when(_kind(value, path) == "BIGINT", F.try_variant_get(value, path, "bigint"))


def _position(part: Column) -> Column:
    at = _whole(part, "$.timestamp")
    plausible = (at >= PLAUSIBLE_MS_FROM) & (at < PLAUSIBLE_MS_TO)
    topic = F.coalesce(F.try_variant_get(part, "$.topic", "string"), F.lit("None"))
    return F.struct(
        F.substring_index(topic, ".", 1).alias("stream"),
        F.when(plausible, iso(F.timestamp_millis(at))).alias("at"),
        _whole(part, "$.offset").alias("offset"),
    )


def positions(sse_id: Column | str) -> Column:
    """`[{stream, at, offset}]`; NULL unless the id is a list of objects that all name a topic."""
    parts = F.try_variant_get(F.try_parse_json(sse_id), "$", "array<variant>")
    named = F.forall(parts, lambda p: _kind(p, "$.topic").isNotNull())
    return F.when(named, F.transform(parts, _position))


def shorten(sse_id: Column | str) -> Column:
    """`{positions, bytes}` for the report, or NULL."""
    found = positions(sse_id)
    return F.when(
        found.isNotNull(),
        F.struct(found.alias("positions"), F.octet_length(sse_id).alias("bytes")),
    )
