"""Activity over a chosen window and languages."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import PAGES_KEPT_S, PREAGGREGATED_WINDOWS, WINDOWS_S
from tidemark.functions.ratios import share
from tidemark.functions.times import at_ms, iso
from tidemark.operators.page_tree import PageSets, pages_in_window
from tidemark.operators.windows import newest_ms, totals_with_pages, window_totals, window_totals_preaggregated


class BadRequest(ValueError):
    """The language list or the window isn't one that is offered."""


@dataclass(frozen=True)
class Request:
    langs: tuple[str, ...]
    window: str


def parse_request(lang: str | None, window: str | None, allowed: Sequence[str]) -> Request:
    """`all` or a comma list (any order, blanks ignored) and a window name (default 5m)."""
    asked = (lang or "all").strip().lower()
    wanted = set(allowed) if asked == "all" else {p.strip() for p in asked.split(",")} - {""}
    if not wanted or not wanted <= set(allowed):
        raise BadRequest(f"lang must be 'all' or a comma list of: {', '.join(allowed)}")
    name = (window or "5m").strip().lower()
    if name not in WINDOWS_S:
        raise BadRequest(f"window must be one of: {', '.join(WINDOWS_S)}")
    return Request(tuple(code for code in allowed if code in wanted), name)


def activity(
    edits: DataFrame,
    per_minute: DataFrame,
    pages: DataFrame | PageSets,
    request: Request,
    now_ms: int,
    to_ms: int | None = None,
) -> DataFrame:
    """One row, for the window ending at `to_ms` (the newest event, read here if not given). Windows up to a day read raw rows; 3 and 7 days read the pre-aggregates.

    Given the tree of page sets, a window is covered by whole days, hours and minutes; given minute sets alone, by minutes.
    Pages are unknown (NULL) when a pre-aggregated window starts before the page sets are kept.
    """
    to_ms = newest_ms(edits) if to_ms is None else to_ms
    window_s = WINDOWS_S[request.window]
    preaggregated = request.window in PREAGGREGATED_WINDOWS
    if to_ms is None:
        totals = edits.sparkSession.createDataFrame([], "lang STRING, edits BIGINT, pages BIGINT, bot_edits BIGINT")
    elif preaggregated:
        if isinstance(pages, PageSets):
            totals = totals_with_pages(per_minute, pages_in_window(pages, to_ms, window_s, request.langs), to_ms, window_s, request.langs)
        else:
            totals = window_totals_preaggregated(per_minute, pages, to_ms, window_s, request.langs)
    else:
        totals = window_totals(edits, to_ms, window_s, request.langs)
    expired = preaggregated and to_ms is not None and to_ms - window_s * 1000 < now_ms - PAGES_KEPT_S * 1000
    summed = totals.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("edits", "pages", "bot_edits")])
    newest = F.lit(to_ms).cast("bigint")
    return summed.select(
        F.lit(",".join(request.langs)).alias("lang"),
        F.lit(request.window).alias("window"),
        iso(at_ms(now_ms)).alias("generated_at"),
        "edits",
        (F.lit(None).cast("bigint") if expired else F.col("pages")).alias("pages_edited"),
        share("bot_edits", "edits").alias("bot_share"),
        iso(F.timestamp_millis(newest)).alias("as_of"),
        F.when(newest.isNotNull(), F.greatest(F.lit(0), F.lit(now_ms) - newest) / 1000).alias("last_event_age_s"),
    )
