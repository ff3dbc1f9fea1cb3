"""Page sets as a tree of time: minutes, hours, days. A window is covered by the fewest nodes, and their union is counted exactly.

A set only grows and its members are stored one row each, so a node may lie in many writes until they are folded,
and a page that is added twice changes nothing. An hour's set is much smaller than its minutes' together, a day's smaller still.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import DAY_S, HOUR_S, MINUTE_S
from tidemark.functions.times import at_s, hour
from tidemark.operators.windows import floor_minute_ms, prune_days

MEMBER = ("lang", "namespace", "title")


@dataclass(frozen=True)
class PageSets:
    """The sets of every minute (`minute`), hour (`hour`) and day (`dt`), one row a member."""

    minutes: DataFrame
    hours: DataFrame
    days: DataFrame


def per_hour(edits: DataFrame) -> DataFrame:
    """The pages edited in each hour. Takes edits or minute sets."""
    moment = "event_time" if "event_time" in edits.columns else "minute"
    return edits.select(hour(moment).alias("hour"), *MEMBER).distinct()


def per_day(edits: DataFrame) -> DataFrame:
    """The pages edited on each day. Takes edits, minute sets or hour sets."""
    moment = next(c for c in ("event_time", "minute", "hour") if c in edits.columns)
    return edits.select(F.to_date(moment).alias("dt"), *MEMBER).distinct()


def cover(from_s: int, to_s: int) -> dict[str, list[tuple[int, int]]]:
    """Ranges `[from, to)` of whole days, hours and minutes that make up a range of whole minutes, as few nodes as there can be.

    Whole days in the middle, whole hours around them, minutes at the ends: at most one range of days and two of each other.
    """
    ranges: dict[str, list[tuple[int, int]]] = {"days": [], "hours": [], "minutes": []}

    def split(a: int, b: int, steps: Sequence[tuple[str, int]]) -> None:
        if a >= b:
            return
        (name, size), *finer = steps
        first, last = -(-a // size) * size, b // size * size
        if first < last:
            split(a, first, finer)
            ranges[name].append((first, last))
            split(last, b, finer)
        else:
            split(a, b, finer)

    split(from_s, to_s, (("days", DAY_S), ("hours", HOUR_S), ("minutes", MINUTE_S)))
    return ranges


def members(sets: PageSets, from_s: int, to_s: int) -> DataFrame:
    """Pages of a range of whole minutes, from the nodes that cover it; a page may come up more than once."""
    frames = {"days": (sets.days, F.to_timestamp("dt")), "hours": (sets.hours, F.col("hour")), "minutes": (sets.minutes, F.col("minute"))}
    parts = []
    for name, ranges in cover(from_s, to_s).items():
        rows, moment = frames[name]
        for a, b in ranges:
            inside = prune_days(rows, a * 1000, b * 1000 - 1)
            if name != "days":  # whole days are whole partitions
                inside = inside.where((moment >= at_s(a)) & (moment < at_s(b)))
            parts.append(inside.select(*MEMBER))
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    return found


def pages_in_window(sets: PageSets, to_ms: int, window_s: int, langs: Sequence[str]) -> DataFrame:
    """Distinct pages per language in the minutes after `floor(to) - window`, up to the newest one."""
    last = floor_minute_ms(to_ms) // 1000 + MINUTE_S
    rows = members(sets, last - window_s, last).where(F.col("lang").isin(*langs))
    return rows.groupBy("lang").agg(F.count_distinct("namespace", "title").alias("pages"))
