"""Recorded holes in the data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import DAY_S, GAP_WINDOW_DAYS, MAX_GAPS
from tidemark.functions.status import gap_duration_s
from tidemark.functions.times import at_ms, ms


def gaps_with_total(
    gaps: DataFrame, now_ms: int, days: int = GAP_WINDOW_DAYS, limit: int = MAX_GAPS
) -> DataFrame:
    """The newest gaps of the last `days` days, each beside the count of all of them.

    The count is its own aggregate; the list is a top-n. Neither sorts nor gathers every gap.
    """
    current = gaps.where(F.col("gap_to") > at_ms(now_ms - days * DAY_S * 1000))
    total = current.agg(F.count(F.lit(1)).alias("total"))
    newest = current.orderBy(F.col("gap_from").desc(), F.col("gap_to").desc(), "reason").limit(limit)
    return newest.select(
        ms("gap_from").alias("from_ms"),
        ms("gap_to").alias("to_ms"),
        gap_duration_s("gap_from", "gap_to").alias("duration_s"),
        "reason",
        total.scalar().alias("total"),
    )
