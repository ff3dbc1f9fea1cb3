"""Fixed values of the data product, and the one settings object jobs pass around."""

from __future__ import annotations

from dataclasses import dataclass, field

# Fixed values.
LANGS = ("en", "pt", "de")
WIKIS = ("enwiki", "ptwiki", "dewiki")
EDIT_TYPES = ("edit", "new")
OUTCOMES = (
    "kept",
    "canary",
    "other_wiki",
    "other_type",
    "malformed",
    "future",
    "before_floor",
    "duplicate",
)

MINUTE_S = 60
HOUR_S = 3_600
DAY_S = 86_400

MAX_FUTURE_S = 300
MAX_TITLE_BYTES = 1_024
FIRST_YEAR, LAST_YEAR = 1971, 2105
INT32_MIN, INT32_MAX = -(2**31), 2**31 - 1

SNAPSHOT_WINDOW_S = 300
SNAPSHOT_MINUTES = 60
TOP_N = 5

WINDOWS_S = {"5m": 300, "1h": 3_600, "24h": 86_400, "3d": 259_200, "7d": 604_800}
PREAGGREGATED_WINDOWS = ("3d", "7d")
PAGES_KEPT_S = 13 * DAY_S

LAG_WINDOW_S = 3_600
RECONNECT_WINDOW_S = 86_400
GAP_WINDOW_DAYS = 30
MAX_GAPS = 20

PLAUSIBLE_MS_FROM, PLAUSIBLE_MS_TO = 946_684_800_000, 4_102_444_800_000

SEAM_WINDOW_NS = 3_600 * 10**9
RESTORE_MARGIN_S = 1_800

REBUILD_MAX_DAYS = 31
RAW_RESTORE_DAYS = 2
RETENTION_DAYS = {
    "edits": 7,
    "pages_per_minute": 14,
    "pages_per_hour": 14,
    "pages_per_day": 14,
    "pages_filled": 14,
    "edits_per_minute": 90,
    "ingest_gaps": 90,
    "ingest_reconnects": 90,
    "freshness_samples": 90,
    "aws_cost": 90,
}


@dataclass(frozen=True)
class Settings:
    """What an installation may choose. Defaults are the product's own."""

    langs: tuple[str, ...] = LANGS
    wikis: tuple[str, ...] = WIKIS
    types: tuple[str, ...] = EDIT_TYPES
    flush_interval_s: int = 1
    flush_max_rows: int = 5_000
    first_boot_lookback_s: int = 3_600
    source_retention_s: int = 7 * DAY_S
    seam_ids: int = 20_000
    stale_after_s: float = 60.0
    slo_target: float = 0.999
    slo_threshold_s: float = 60.0
    settle_s: int = 300
    lookback_s: int = 7 * DAY_S
    reconcile_settle_s: int = 900
    quiet_s: int = 30
    cost_source: str = "UnblendedCost"
    retention_days: dict[str, int] = field(default_factory=lambda: dict(RETENTION_DAYS))


DEFAULTS = Settings()
