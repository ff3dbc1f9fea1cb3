"""The same answers in plain SQL over the given tables, one statement per registered query."""

from __future__ import annotations

from tidemark.checks import inputs_sql as inp
from tidemark.config import WINDOWS_S

_E = (inp.BASE, inp.EDITS)
_EH = (*_E, inp.HEAD)
_EHN = (*_EH, inp.NOW)
_R = (*_EHN, inp.ROLLUP)
_RP = (*_R, inp.PAGES)
_LANGS = "('en','pt','de')"

SQL: dict[str, str] = {}


def add(name: str, ctes: tuple[str, ...], body: str) -> None:
    SQL[name] = inp.with_inputs(*ctes) + body


def _recent(seconds: int) -> str:
    return f"event_time > (SELECT t FROM head) - INTERVAL {seconds} SECOND AND event_time <= (SELECT t FROM head)"


def _minutes(seconds: int) -> str:
    start = f"date_trunc('minute', (SELECT t FROM head)) - INTERVAL {seconds} SECOND"
    return f"minute > {start} AND minute <= (SELECT t FROM head)"


def _totals(seconds: int, langs: str = _LANGS) -> str:
    return f"""SELECT lang, count(*) AS edits, count(DISTINCT (namespace, title)) AS pages,
      count(*) FILTER (WHERE is_bot) AS bot_edits FROM edits WHERE {_recent(seconds)} AND lang IN {langs} GROUP BY lang"""


def _pre_totals(seconds: int, langs: str = _LANGS) -> str:
    return f"""SELECT e.lang, e.edits, coalesce(p.pages, 0) AS pages, e.bot_edits FROM
      (SELECT lang, CAST(sum(edits) AS BIGINT) AS edits, CAST(sum(bot_edits) AS BIGINT) AS bot_edits FROM rollup
        WHERE {_minutes(seconds)} AND lang IN {langs} GROUP BY lang) e LEFT JOIN
      (SELECT lang, count(DISTINCT (namespace, title)) AS pages FROM pages_pm
        WHERE {_minutes(seconds)} AND lang IN {langs} GROUP BY lang) p USING (lang)"""


def _share(part: str, whole: str, places: int = 4) -> str:
    return f"CASE WHEN {whole} > 0 THEN CAST(printf('%.{places}f', CAST({part} AS DOUBLE) / {whole}) AS DOUBLE) END"


def _iso(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%dT%H:%M:%S.%g') || 'Z'"


add("newest", _E, "SELECT epoch_ms(max(event_time)) AS newest_ms, count(*) AS n FROM edits")
for _name, _s in WINDOWS_S.items():
    add(f"window_totals_{_name}", _EH, _totals(_s))
for _name in ("24h", "3d", "7d"):
    add(f"window_from_rollup_{_name}", _RP, _pre_totals(WINDOWS_S[_name]))

add(
    "window_totals_all",
    (*_EH, f"totals AS ({_totals(86_400)})"),
    f"""SELECT lang, edits, pages, bot_edits, {_share('bot_edits', 'edits')} AS bot_share FROM (
      SELECT * FROM totals UNION ALL SELECT 'all', coalesce(CAST(sum(edits) AS BIGINT), 0),
        coalesce(CAST(sum(pages) AS BIGINT), 0), coalesce(CAST(sum(bot_edits) AS BIGINT), 0) FROM totals)""",
)


def _tops(seconds: int) -> str:
    return f"""SELECT lang, title, edits FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY edits DESC, title) AS rn
      FROM (SELECT lang, title, count(*) AS edits FROM edits WHERE {_recent(seconds)} AND namespace = 0 GROUP BY 1, 2)) WHERE rn <= 5"""


_ENC = "replace(replace(replace(url_encode(replace({t}, ' ', '_')), '+', '%20'), '*', '%2A'), '%7E', '~')"


def _url(lang: str, title: str) -> str:
    return f"concat('https://', {lang}, '.wikipedia.org/wiki/', {_ENC.format(t=title)})"


add("top_articles", _EH, _tops(604_800))
add("top_articles_5m", _EH, _tops(300))
_PLACE = "CASE lang WHEN 'en' THEN 1 WHEN 'pt' THEN 2 ELSE 3 END"
add(
    "top_articles_all",
    (*_EH, f"tops AS ({_tops(604_800)})"),
    f"SELECT lang, title, edits, {_url('lang', 'title')} AS url FROM tops ORDER BY edits DESC, title, {_PLACE} LIMIT 5",
)

_SERIES = """counts AS (SELECT CAST(epoch(minute) AS BIGINT) AS minute_s, lang, edits FROM rollup, head
    WHERE minute > date_trunc('minute', t) - INTERVAL 60 MINUTE AND minute < date_trunc('minute', t)
  UNION ALL SELECT CAST(epoch(date_trunc('minute', t)) AS BIGINT), lang, count(*) FROM edits, head
    WHERE event_time >= date_trunc('minute', t) AND event_time <= t GROUP BY 1, 2)"""
add("edits_per_minute", (*_R, _SERIES), "SELECT minute_s, lang, edits FROM counts")

_RECENT_GAPS = """recent_gaps AS (SELECT gap_from, gap_to FROM gaps, head
    WHERE gap_to > t - INTERVAL 60 MINUTE AND gap_from <= t)"""


def _chart(gaps: bool) -> str:
    blank = """NOT EXISTS (SELECT 1 FROM recent_gaps WHERE gap_from < to_timestamp(m + 60)::TIMESTAMP
      AND gap_to > to_timestamp(m)::TIMESTAMP)""" if gaps else "true"
    return f"""spine AS (SELECT CAST(epoch(date_trunc('minute', t)) AS BIGINT) - 60 * i AS m FROM head, range(60) r(i)),
  known AS (SELECT m, EXISTS (SELECT 1 FROM counts WHERE minute_s = m) AND {blank} AS known,
    m = (SELECT max(m) FROM spine) AS partial FROM spine),
  chart AS (SELECT l.lang, m AS t, CASE WHEN known THEN coalesce((SELECT CAST(sum(edits) AS BIGINT) FROM counts
      WHERE minute_s = m AND (counts.lang = l.lang OR l.lang = 'all')), 0) END AS edits, partial
    FROM known, (VALUES ('en'), ('pt'), ('de'), ('all')) l(lang))"""


add("minute_series_60", (*_R, _SERIES, _chart(False)), "SELECT * FROM chart")
add("minute_series_with_gaps", (*_R, inp.GAPS, _SERIES, _RECENT_GAPS, _chart(True)), "SELECT * FROM chart")
add("recent_gaps", (*_EH, inp.GAPS, _RECENT_GAPS), "SELECT epoch_ms(gap_from) AS from_ms, epoch_ms(gap_to) AS to_ms FROM recent_gaps")

_GAPS_TOTAL = """gap_list AS (SELECT epoch_ms(gap_from) AS from_ms, epoch_ms(gap_to) AS to_ms,
    CAST(greatest(0, round_even((epoch_ms(gap_to) - epoch_ms(gap_from)) / 1000.0, 0)) AS BIGINT) AS duration_s, reason,
    count(*) OVER () AS total FROM gaps, clock WHERE gap_to > now - INTERVAL 30 DAY
    ORDER BY gap_from DESC, gap_to DESC, reason LIMIT 20)"""
add("gaps_with_total", (*_EHN, inp.GAPS, _GAPS_TOTAL), "SELECT * FROM gap_list")

_MIN_S = "CAST(epoch(minute) AS BIGINT) AS minute_s"
add("rollup_per_minute", _R, f"SELECT {_MIN_S}, lang, edits, bot_edits FROM rollup")
add("rollup_merged_partials", _R, f"SELECT {_MIN_S}, lang, edits, bot_edits FROM rollup")
add("pages_per_minute", _RP, f"SELECT {_MIN_S}, lang, namespace, title FROM pages_pm")
add("pages_merged_twice", _RP, f"SELECT {_MIN_S}, lang, namespace, title FROM pages_pm")
add(
    "pages_per_hour",
    _E,
    """SELECT CAST(epoch(date_trunc('hour', event_time)) AS BIGINT) AS hour_s, lang,
      count(DISTINCT (namespace, title)) AS pages FROM edits GROUP BY 1, 2""",
)
add(
    "minute_coverage",
    _E,
    """SELECT count(DISTINCT date_trunc('minute', event_time)) AS present,
      CAST(date_diff('minute', min(event_time), max(event_time)) + 1 AS BIGINT) AS span FROM edits""",
)
add("newest_rollup_minute", _R, "SELECT CAST(epoch(max(minute)) AS BIGINT) AS newest_s, count(*) AS n FROM rollup")
_STAGED = """staged AS (SELECT CAST(epoch(date_trunc('hour', minute)) AS BIGINT) AS hour_s, count(*) AS rows,
    CAST(sum(edits) AS BIGINT) AS edits FROM rollup GROUP BY 1)"""
add("staged_hours", (*_R, _STAGED), "SELECT * FROM staged")

_RANKED = """ranked AS (SELECT list_sort(list(epoch_ms(ingested_at) - epoch_ms(event_time))) AS xs, count(*) AS events FROM {where})"""
_QUANT = """SELECT events, xs[CAST(least(floor(CAST(0.5 AS DOUBLE) * events), events - 1) AS BIGINT) + 1] AS p50_ms,
      xs[CAST(least(floor(CAST(0.95 AS DOUBLE) * events), events - 1) AS BIGINT) + 1] AS p95_ms FROM ranked"""
add("ingest_lag_quantiles", (*_EH, _RANKED.format(where=f"edits WHERE {_recent(60)}")), _QUANT)
_STORED = "edits, clock WHERE ingested_at > now - INTERVAL {s} SECOND"
add("stored_lag_last_hour", (*_EHN, _RANKED.format(where=_STORED.format(s=3_600))), _QUANT)
add("stored_lag_month", (*_EHN, _RANKED.format(where=_STORED.format(s=31 * 86_400))), _QUANT)

_REASONS = """reasons AS (SELECT reason, count(*) AS n FROM reconnects, clock WHERE "at" > now - INTERVAL 86400 SECOND GROUP BY reason)"""
add("reconnects_by_reason", (*_EHN, inp.RECONNECTS, _REASONS), "SELECT * FROM reasons")

add("first_sample", (*_E, inp.SAMPLES), "SELECT epoch_ms(min(sampled_at)) AS first_ms, count(*) AS n FROM samples")
_FRESH = """SELECT count(*) AS sampled, count(*) FILTER (WHERE fresh) AS fresh FROM (
      SELECT minute, bool_and(coalesce(age_s < 60, false)) AS fresh FROM samples{more} WHERE {where} GROUP BY minute)"""
add(
    "freshness_minutes",
    (*_EH, inp.SAMPLES),
    _FRESH.format(
        more=", head", where="minute >= date_trunc('minute', t) - INTERVAL 30 DAY AND minute < date_trunc('minute', t)"
    ),
)
_WIN = """win AS (SELECT *, (end_s - start_s) // 60 AS minutes, start_s <= month_s AS full_window FROM (
    SELECT least(greatest(month_s, first_whole), end_s) AS start_s, end_s, month_s, month_days FROM (
      SELECT CAST(epoch(date_trunc('month', now)) AS BIGINT) AS month_s,
        CAST(ceil((SELECT epoch_ms(min(sampled_at)) FROM samples) / 60000.0) AS BIGINT) * 60 AS first_whole,
        CAST(epoch(date_trunc('minute', now)) AS BIGINT) AS end_s,
        CAST(day(last_day(now)) AS INTEGER) AS month_days FROM clock)))"""
add("slo_window", (*_EHN, inp.SAMPLES, _WIN), "SELECT * FROM win")
_SLO = (
    "counted AS (" + _FRESH.format(
        more=", win", where="minute >= to_timestamp(start_s)::TIMESTAMP AND minute < to_timestamp(end_s)::TIMESTAMP"
    ) + ")"
)
_SLO_REPORT = f"""slo AS (SELECT CAST(0.999 AS DOUBLE) AS target, CAST(60 AS DOUBLE) AS threshold_s,
    strftime(to_timestamp(month_s)::TIMESTAMP, '%Y-%m') AS month, month_days AS window_days,
    {_iso("to_timestamp(start_s)::TIMESTAMP")} AS "from", {_iso("to_timestamp(end_s)::TIMESTAMP")} AS "to",
    minutes, f AS fresh, s - f AS stale, minutes - s AS unmeasured,
    CASE WHEN minutes > 0 THEN CAST(printf('%.6f', CAST(f AS DOUBLE) / minutes) AS DOUBLE) END AS ratio,
    CASE WHEN minutes > 0 THEN CAST(f AS DOUBLE) / minutes >= 0.999 END AS met,
    CAST(round_even(month_days * 1440 * (1 - CAST(0.999 AS DOUBLE)), 0) AS BIGINT) AS budget_minutes,
    minutes - f AS budget_used, full_window
    FROM (SELECT *, least(fresh, s) AS f FROM (SELECT *, least(sampled, minutes) AS s FROM counted, win)))"""
add("slo_report", (*_EHN, inp.SAMPLES, _WIN, _SLO, _SLO_REPORT), "SELECT * FROM slo")
add(
    "freshness_sample",
    _EHN,
    """SELECT CAST(epoch(date_trunc('minute', now)) AS BIGINT) AS minute_s, epoch_ms(now) AS sampled_ms,
      CAST((epoch_ms(now) - epoch_ms(t)) / 1000.0 AS DOUBLE) AS age_s FROM clock, head""",
)

_C = (*_EHN, inp.ANSWERS, inp.COSTS)
add(
    "cost_answers",
    _C,
    """SELECT epoch_ms(fetched_at) AS fetched_ms, ok, CAST(period_start AS VARCHAR) AS period_start,
      CAST(period_end AS VARCHAR) AS period_end, amount, currency, estimated, error FROM costs""",
)
_GOOD = "ok AND period_start = (SELECT date_trunc('month', now)::DATE FROM clock)"
_FIGURE = f"""figure AS (SELECT count(*) AS attempts, epoch_ms(max(fetched_at)) AS fetched_ms, arg_max(ok, fetched_at) AS last_ok,
    count(*) FILTER (WHERE {_GOOD}) AS figures, epoch_ms(max(fetched_at) FILTER (WHERE {_GOOD})) AS figure_ms,
    CAST(arg_max(period_start, fetched_at) FILTER (WHERE {_GOOD}) AS VARCHAR) AS fig_period_start,
    CAST(arg_max(period_end, fetched_at) FILTER (WHERE {_GOOD}) AS VARCHAR) AS fig_period_end,
    arg_max(amount, fetched_at) FILTER (WHERE {_GOOD}) AS fig_amount,
    arg_max(currency, fetched_at) FILTER (WHERE {_GOOD}) AS fig_currency,
    arg_max(estimated, fetched_at) FILTER (WHERE {_GOOD}) AS fig_estimated FROM costs)"""
add("cost_figure", (*_C, _FIGURE), "SELECT * FROM figure")
_CHECK = """CASE WHEN make_timestamp(fetched_ms * 1000)::DATE <> now::DATE THEN 'pending' WHEN last_ok THEN 'ok' ELSE 'failed' END"""
add("cost_check", (*_C, _FIGURE), f"SELECT {_CHECK} AS today, fetched_ms FROM figure, clock")
add("cost_attempts_today", _C, "SELECT count(*) AS n FROM costs, clock WHERE fetched_at::DATE = now::DATE")

_HEAD3 = "SELECT epoch_ms(max(event_time)) AS newest_ms, epoch_ms(max(ingested_at)) AS stored_ms, count(*) AS n FROM edits"
add("head", _E, _HEAD3)
add(
    "ingest_state",
    (*_E, f"h3 AS ({_HEAD3})"),
    """SELECT CAST(after_ms AS INTEGER) AS after_ms,
      CASE WHEN after_ms <= 60000 THEN 'live' WHEN newest_ms + after_ms - stored_ms <= 60000 THEN 'catching_up' ELSE 'paused' END AS state,
      CASE WHEN after_ms <= 60000 THEN 'live' ELSE 'stale' END AS snapshot_status
      FROM h3, (VALUES (0), (60000), (60100), (61500), (600000)) a(after_ms)""",
)

_M = (inp.BASE, inp.MESSAGES, inp.CLASSIFIED)
add("classify_outcomes", _M, "SELECT outcome, count(*) AS n FROM classified GROUP BY outcome")
add(
    "classified_rows",
    _M,
    """SELECT position, raw_id AS event_id, epoch_ms(instant) AS event_ms, epoch_ms(received_at) AS ingested_ms, wiki,
      replace(wiki, 'wiki', '') AS lang, type, CAST(ns AS INTEGER) AS namespace, title, coalesce(bot, false) AS is_bot, sse_id
      FROM classified WHERE outcome = 'kept'""",
)
add(
    "seam_dedup",
    (inp.BASE, inp.EDITS, inp.MESSAGES, inp.CLASSIFIED),
    """SELECT event_id, position, 1000 + position AS ingest_seq, epoch_ms(event_time) AS event_ms FROM stored
      WHERE event_id NOT IN (SELECT concat('00000000-0000-4000-8000-', lpad(event_id, 12, '0')) FROM
        (SELECT event_id FROM edits WHERE is_bot))""",
)
add("ingest_tail", _E, "SELECT event_id, sse_id, ingest_seq FROM edits ORDER BY ingest_seq DESC LIMIT 20000")
add("latest_bookmark", _E, "SELECT arg_max(sse_id, ingest_seq) AS sse_id FROM edits HAVING arg_max(sse_id, ingest_seq) <> ''")
add("max_ingest_seq", _E, "SELECT max(ingest_seq) AS seq FROM edits")
add(
    "batch_token",
    _E,
    """SELECT CAST(event_time::DATE AS VARCHAR) AS day, ingest_seq // 5000 AS batch, count(*) AS rows,
      left(sha256(string_agg(event_id, chr(10) ORDER BY ingest_seq)), 32) AS token FROM edits GROUP BY 1, 2""",
)
add(
    "bookmark_positions",
    _E,
    f"""SELECT event_id, split_part(json_extract_string(p, '$.topic'), '.', 1) AS stream,
      {_iso("make_timestamp(CAST(json_extract(p, '$.timestamp') AS BIGINT) * 1000)")} AS "at",
      CAST(json_extract(p, '$.offset') AS BIGINT) AS "offset", CAST(strlen(sse_id) AS INTEGER) AS bytes
      FROM (SELECT event_id, sse_id, unnest(CAST(sse_id AS JSON[])) AS p FROM edits)""",
)
_NULLS = "CAST(NULL AS BIGINT)"
add(
    "resume_state",
    _EHN,
    f"""SELECT 'bookmark' AS start, arg_max(sse_id, ingest_seq) AS bookmark, {_NULLS} AS since_ms, {_NULLS} AS floor_ms,
      max(ingest_seq) AS last_seq, epoch_ms(max(event_time)) AS newest_ms, {_NULLS} AS gap_from_ms, {_NULLS} AS gap_to_ms FROM edits""",
)
add(
    "resume_after_restore",
    _EHN,
    f"""SELECT 'after_restore' AS start, CAST(NULL AS VARCHAR) AS bookmark,
      greatest(epoch_ms(least(max(ingested_at), CASE WHEN date_trunc('hour', max(event_time)) = max(event_time) THEN max(event_time)
        ELSE date_trunc('hour', max(event_time)) + INTERVAL 1 HOUR END) - INTERVAL 30 MINUTE), epoch_ms((SELECT now FROM clock) - INTERVAL 7 DAY)) AS since_ms,
      epoch_ms(date_trunc('day', min(event_time))) AS floor_ms, max(epoch_ms(ingested_at)) * 1000000 AS last_seq,
      {_NULLS} AS newest_ms, {_NULLS} AS gap_from_ms, {_NULLS} AS gap_to_ms FROM edits""",
)
_TITLE = "concat('A (b) * ~ ü/ß ', event_type, ' ', CAST(user_id % 50 AS VARCHAR))"
add("article_url", (inp.BASE,), f"SELECT event_id, {_url('lang', _TITLE)} AS url, lang FROM base")
add(
    "archive_paths",
    _E,
    """SELECT event_id, concat('s3a://b/e/', strftime(event_time, 'dt=%Y-%m-%d/hour=%H')) AS path,
      CAST(epoch(date_trunc('hour', event_time)) AS BIGINT) AS hour_s,
      CAST(epoch(date_trunc('hour', event_time)) AS BIGINT) AS file_hour_s, CAST(NULL AS BIGINT) AS broken_s FROM edits""",
)
# the printed digits of the double decide, not a rounding formula
SQL["share_ties"] = """SELECT part, whole, CAST(printf('%.4f', CAST(part AS DOUBLE) / whole) AS DOUBLE) AS share
  FROM (SELECT DISTINCT CAST(o_orderkey % 20000 AS BIGINT) AS part FROM orders), (SELECT CAST(unnest([20000, 24640, 20480]) AS BIGINT) AS whole)
  WHERE part <= whole"""

add(
    "time_functions",
    _E,
    f"""SELECT event_id, CAST(epoch(date_trunc('minute', event_time)) AS BIGINT) AS minute_s,
      CAST(epoch(date_trunc('hour', event_time)) AS BIGINT) AS hour_s,
      CAST(epoch(CASE WHEN date_trunc('hour', event_time) = event_time THEN event_time
        ELSE date_trunc('hour', event_time) + INTERVAL 1 HOUR END) AS BIGINT) AS ceil_hour_s,
      CAST(epoch(date_trunc('day', event_time)) AS BIGINT) AS day_s,
      CAST(strftime(event_time, '%Y%m') AS BIGINT) AS yyyymm, epoch_ms(event_time) AS ms, epoch_us(event_time) * 1000 AS ns,
      {_iso('event_time')} AS iso, epoch_ms(ingested_at) - epoch_ms(event_time) AS lag_ms,
      CAST(day(last_day(event_time)) AS BIGINT) AS month_days, CAST(date_trunc('month', event_time)::DATE AS VARCHAR) AS month FROM edits""",
)

_HOUR_S = "CAST(epoch(date_trunc('hour', event_time)) AS BIGINT)"
_RAW_HOURS = f"raw_hours AS (SELECT {_HOUR_S} AS hour_s, count(*) AS rows FROM edits GROUP BY 1)"
_LATEST = """latest AS (SELECT CAST(epoch(hour) AS BIGINT) AS hour_s, arg_max(rows, (written_at, rows)) AS rows FROM ledger GROUP BY 1)"""
_L = (*_EHN, inp.HELD, inp.RECORDED, _LATEST)
add("hour_counts", (*_E, _RAW_HOURS), "SELECT * FROM raw_hours")
add(
    "raw_span",
    _E,
    """SELECT epoch_ms(min(event_time)) AS oldest_ms, epoch_ms(max(event_time)) AS newest_ms,
      epoch_ms(max(event_time)) // 1000 AS newest_s, epoch_ms(max(ingested_at)) AS ingested_ms, count(*) AS n FROM edits""",
)
add("recorded_counts_latest", _L, "SELECT * FROM latest")
add(
    "archive_plan_due",
    (*_L, _RAW_HOURS),
    """SELECT hour_s, r.rows, coalesce(l.rows, 0) AS in_file FROM raw_hours r LEFT JOIN latest l USING (hour_s), (
        SELECT CAST(ceil(greatest((SELECT epoch_ms(min(event_time)) FROM edits), epoch_ms(now) - 604800000) / 3600000.0) AS BIGINT) * 3600 AS lo,
          (epoch_ms(t) // 1000 - 300) // 3600 * 3600 AS hi FROM clock, head)
      WHERE hour_s >= lo AND hour_s < hi AND r.rows > coalesce(l.rows, 0)""",
)
add(
    "missing_hours",
    _L,
    """SELECT h AS hour_s FROM (SELECT unnest(range(epoch_ms(min(event_time)) // 3600000 * 3600, epoch_ms(max(event_time)) // 1000, 3600)) AS h FROM edits)
      WHERE h NOT IN (SELECT hour_s FROM latest)""",
)
add("unfilled_hours", _L, "SELECT hour_s FROM latest WHERE hour_s // 3600 % 3 = 0")
add(
    "short_hours",
    (*_L, inp.ROLLUP, _STAGED),
    """SELECT hour_s, l.rows, coalesce(s.edits, 0) AS staged_edits FROM latest l LEFT JOIN staged s USING (hour_s)
      WHERE coalesce(s.edits, 0) <> l.rows""",
)
add(
    "month_pieces",
    _E,
    """SELECT CAST(greatest(d, m) AS VARCHAR) AS piece_from, CAST(least(d + 45, (m + INTERVAL 1 MONTH)::DATE) AS VARCHAR) AS piece_to,
      count(*) AS n FROM (SELECT d, unnest(range(date_trunc('month', d), (d + 45)::TIMESTAMP, INTERVAL 1 MONTH))::DATE AS m
        FROM (SELECT event_time::DATE AS d FROM edits)) GROUP BY 1, 2""",
)

_SETTLED = """bounds AS (SELECT (epoch_ms((SELECT min(event_time) FROM edits)) // 1000 // 60 + 1) * 60 AS lo,
    (epoch_ms(now) // 1000 - 900) // 60 * 60 AS hi FROM clock)"""
_MISMATCH = """wrong AS (SELECT CAST(epoch(minute) AS BIGINT) AS minute_s, lang, coalesce(r.edits, 0) AS raw, coalesce(d.edits, 0) AS rolled
    FROM rollup r FULL OUTER JOIN drifted d USING (minute, lang), bounds
    WHERE epoch(minute) >= lo AND epoch(minute) < hi AND coalesce(r.edits, 0) <> coalesce(d.edits, 0))"""
add("reconcile_mismatches", (*_R, inp.DRIFTED, _SETTLED, _MISMATCH), "SELECT * FROM wrong")
add(
    "reconcile_repair",
    (*_R, inp.DRIFTED, _SETTLED, _MISMATCH),
    f"""SELECT {_MIN_S}, lang, edits, bot_edits FROM drifted WHERE epoch(minute) NOT IN (SELECT minute_s FROM wrong)
      UNION ALL SELECT {_MIN_S}, lang, edits, bot_edits FROM rollup WHERE epoch(minute) IN (SELECT minute_s FROM wrong)""",
)

# --- documents -----------------------------------------------------------------------------------

_SNAP = (
    *_R,
    inp.GAPS,
    _SERIES,
    _RECENT_GAPS,
    _chart(True),
    f"totals AS ({_totals(300)})",
    f"tops AS ({_tops(300)})",
    f"""articles AS (SELECT g.lang, to_json(list(struct_pack(title := a.title, lang := a.lang, edits := a.edits, url := {_url('a.lang', 'a.title')})
        ORDER BY a.edits DESC, a.title, {_PLACE.replace('lang', 'a.lang')})[1:5]) AS top_articles
      FROM tops a, (VALUES ('en'), ('pt'), ('de'), ('all')) g(lang) WHERE g.lang IN (a.lang, 'all') GROUP BY g.lang)""",
    """charts AS (SELECT lang, to_json(list(struct_pack(t := t, edits := edits, partial := partial) ORDER BY t)) AS per_minute
      FROM chart GROUP BY lang)""",
    """summed AS (SELECT g.lang, coalesce(CAST(sum(t.edits) AS BIGINT), 0) AS e, coalesce(CAST(sum(t.pages) AS BIGINT), 0) AS p,
        coalesce(CAST(sum(t.bot_edits) AS BIGINT), 0) AS b
      FROM (VALUES ('en'), ('pt'), ('de'), ('all')) g(lang) LEFT JOIN totals t ON g.lang IN (t.lang, 'all') GROUP BY g.lang)""",
    f"""langs AS (SELECT s.lang, e AS edits_5m, p AS pages_5m, {_share('b', 'e')} AS bot_share_5m,
        coalesce(top_articles, '[]') AS top_articles, per_minute
      FROM summed s LEFT JOIN articles USING (lang) JOIN charts USING (lang))""",
)
add("snapshot_langs", _SNAP, "SELECT lang, edits_5m, pages_5m, bot_share_5m, CAST(top_articles AS VARCHAR) AS top_articles, CAST(per_minute AS VARCHAR) AS per_minute FROM langs")


def _num(expr: str) -> str:
    """A double as JSON text writes it."""
    return f"CAST(CAST({expr} AS DOUBLE) AS VARCHAR)"


def _or_null(expr: str) -> str:
    return f"coalesce(CAST({expr} AS VARCHAR), 'null')"


_LANG_JSON = """concat('"', lang, '":{"edits_5m":', edits_5m, ',"pages_5m":', pages_5m, ',"bot_share_5m":', coalesce(CAST(bot_share_5m AS VARCHAR), 'null'),
      ',"top_articles":', top_articles, ',"per_minute":', per_minute, '}')"""
_LAG_MINUTE = f"lag_minute AS (WITH {_RANKED.format(where=f'edits WHERE {_recent(60)}')} {_QUANT})"
add(
    "snapshot_document",
    (*_SNAP, _LAG_MINUTE),
    f"""SELECT concat('{{"dataset":"wikipedia","status":"live","computed_at":"', {_iso('now')}, '","as_of":"', {_iso('t')},
      '","last_event_age_s":', {_num('(epoch_ms(now) - epoch_ms(t)) / 1000.0')}, ',"stale_after_s":60.0,"ingest_lag_ms":{{"p50":', {_or_null('p50_ms')},
      ',"p95":', {_or_null('p95_ms')}, '}},"window_s":300,"langs":{{',
      (SELECT string_agg({_LANG_JSON}, ',' ORDER BY CASE lang WHEN 'en' THEN 1 WHEN 'pt' THEN 2 WHEN 'de' THEN 3 ELSE 4 END) FROM langs), '}}}}') AS body
      FROM head, clock, lag_minute""",
)


def _activity(window: str, langs: str = _LANGS, names: str = "en,pt,de") -> str:
    seconds = WINDOWS_S[window]
    totals = _pre_totals(seconds, langs) if window in ("3d", "7d") else _totals(seconds, langs)
    return f"""SELECT '{names}' AS lang, '{window}' AS "window", {_iso('now')} AS generated_at, e AS edits, p AS pages_edited,
      {_share('b', 'e')} AS bot_share, {_iso('t')} AS as_of, CAST((epoch_ms(now) - epoch_ms(t)) / 1000.0 AS DOUBLE) AS last_event_age_s
      FROM (SELECT coalesce(CAST(sum(edits) AS BIGINT), 0) AS e, coalesce(CAST(sum(pages) AS BIGINT), 0) AS p,
        coalesce(CAST(sum(bot_edits) AS BIGINT), 0) AS b FROM ({totals})), head, clock"""


for _name in WINDOWS_S:
    add(f"activity_{_name}", _RP, _activity(_name))
add("activity_en_de_24h", _RP, _activity("24h", "('en','de')", "en,de"))

_LAG_HOUR = f"lag_hour AS (WITH {_RANKED.format(where=_STORED.format(s=3_600))} {_QUANT})"
_OPS = (*_C, _FIGURE, inp.GAPS, _GAPS_TOTAL, inp.RECONNECTS, _REASONS, inp.SAMPLES, _WIN, _SLO, _SLO_REPORT, _LAG_HOUR, f"h3 AS ({_HEAD3})")
_MS = "make_timestamp({} * 1000)"
add(
    "ops_document",
    _OPS,
    f"""SELECT concat('{{"generated_at":"', {_iso('now')}, '","ingest":{{"state":"live","newest_event_at":"', {_iso(_MS.format('newest_ms'))},
      '","last_stored_at":"', {_iso(_MS.format('stored_ms'))}, '","stale_after_s":60.0,"lag_ms":{{"p50":', {_or_null('p50_ms')}, ',"p95":', {_or_null('p95_ms')},
      ',"events":', events, ',"window_s":3600}},"bookmark":{{"positions":[{{"stream":"eqiad","at":"', {_iso(_MS.format('newest_ms'))}, '","offset":null}}],"bytes":',
      (SELECT strlen(arg_max(sse_id, ingest_seq)) FROM edits), '}},"reconnects":{{"window_s":86400,"total":', (SELECT coalesce(sum(n), 0) FROM reasons), ',"by_reason":{{',
      coalesce((SELECT string_agg(concat('"', reason, '":', n), ',' ORDER BY n DESC, reason) FROM reasons), ''), '}}}}}},"freshness":',
      (SELECT to_json(slo) FROM slo), ',"gaps":{{"window_days":30,"total":', coalesce((SELECT max(total) FROM gap_list), 0), ',"recent":[',
      coalesce((SELECT string_agg(concat('{{"from":"', {_iso(_MS.format('from_ms'))}, '","to":"', {_iso(_MS.format('to_ms'))}, '","duration_s":', duration_s,
        ',"reason":"', reason, '"}}'), ',' ORDER BY from_ms DESC, to_ms DESC, reason) FROM gap_list), ''), ']}},"cost":',
      CASE WHEN figures = 0 THEN 'null' ELSE concat('{{"amount":"', fig_amount, '","currency":"', fig_currency, '","estimated":', fig_estimated, ',"period_start":"', fig_period_start,
        '","period_end":"', fig_period_end, '","fetched_at":"', {_iso(_MS.format('figure_ms'))}, '","source":"UnblendedCost"}}') END,
      ',"cost_check":{{"today":"', {_CHECK}, '","last_attempt_at":"', {_iso(_MS.format('fetched_ms'))}, '"}}}}') AS body
      FROM clock, h3, lag_hour, figure""",
)

# --- jobs over stored tables ---------------------------------------------------------------------

add(
    "stream_edits",
    _M,
    """SELECT event_id, epoch_ms(event_time) AS event_ms, epoch_ms(ingested_at) AS ingested_ms, wiki, lang, type,
      namespace, title, is_bot, sse_id FROM stored""",
)
add("resumed_edits", _M, "SELECT event_id, epoch_ms(event_time) AS event_ms, lang, title, sse_id FROM stored")
add(
    "resume_gap_recorded",
    _E,
    """SELECT t + 691260000 AS detected_ms, t // 60000 * 60000 AS gap_from_ms, t + 691260000 - 3600000 AS gap_to_ms, 'retention' AS reason
      FROM (SELECT epoch_ms(max(event_time)) AS t FROM edits)""",
)
add(
    "stream_rollup",
    _M,
    """SELECT CAST(epoch(date_trunc('minute', event_time)) AS BIGINT) AS minute_s, lang, count(*) AS edits,
      count(*) FILTER (WHERE is_bot) AS bot_edits FROM stored GROUP BY 1, 2""",
)
add(
    "stream_pages",
    _M,
    """SELECT DISTINCT CAST(epoch(date_trunc('minute', event_time)) AS BIGINT) AS minute_s, lang, namespace, title FROM stored""",
)
add(
    "stream_outcomes",
    _M,
    """SELECT outcome, count(*) AS n FROM classified WHERE outcome <> 'kept' GROUP BY 1
      UNION ALL SELECT 'kept', count(*) FROM stored
      UNION ALL SELECT 'duplicate', (SELECT count(*) FROM classified WHERE outcome = 'kept') - (SELECT count(*) FROM stored)""",
)
add(
    "archive_by_day_lang",
    _E,
    """SELECT CAST(event_time::DATE AS VARCHAR) AS dt, lang, count(*) AS edits,
      round(avg(CASE WHEN is_bot THEN 1.0 ELSE 0.0 END), 3) AS bot_share FROM edits GROUP BY 1, 2""",
)
add(
    "archive_rows",
    _E,
    """SELECT event_id, wiki, lang, type, CAST(namespace AS INTEGER) AS namespace, title, is_bot, strftime(event_time, '%H') AS hour,
      epoch_ms(event_time) AS event_ms, epoch_ms(ingested_at) AS ingested_ms, CAST(event_time::DATE AS VARCHAR) AS dt FROM edits""",
)
add("archive_files", (*_E, _RAW_HOURS), "SELECT hour_s, rows, true AS inside FROM raw_hours")
add(
    "archive_run",
    (*_EH, _RAW_HOURS),
    """SELECT hour_s, 'written' AS result, rows, true AS filled FROM raw_hours, (
        SELECT CAST(ceil(greatest((SELECT epoch_ms(min(event_time)) FROM edits), epoch_ms(t) + 120000 - 604800000) / 3600000.0) AS BIGINT) * 3600 AS lo,
          (epoch_ms(t) // 1000 - 300) // 3600 * 3600 AS hi FROM head) WHERE hour_s >= lo AND hour_s < hi""",
)
add(
    "archive_page_sets",
    _EH,
    """SELECT CAST(epoch(date_trunc('hour', event_time)) AS BIGINT) AS hour_s, lang, count(DISTINCT (namespace, title)) AS pages
      FROM edits, head WHERE event_time::DATE >= (t + INTERVAL 2 MINUTE)::DATE - 14 GROUP BY 1, 2""",
)
for _name in ("rebuild_swap", "restored_minutes", "compacted_rollup"):
    SQL[_name] = SQL["rollup_per_minute"]
SQL["reconcile_job"] = SQL["reconcile_repair"]
add(
    "restored_edits",
    _EH,
    """SELECT event_id, '' AS sse_id, epoch_ms(ingested_at) * 1000000 AS ingest_seq, epoch_ms(event_time) AS event_ms, title
      FROM edits, head WHERE event_time::DATE >= greatest(t::DATE - 1, (t + INTERVAL 2 MINUTE)::DATE - 6)""",
)
add(
    "retained_edits",
    _EHN,
    """SELECT CAST(event_time::DATE AS VARCHAR) AS dt, count(*) AS rows FROM edits, clock
      WHERE event_time::DATE >= now::DATE - 7 GROUP BY 1""",
)
add("reconnects_recorded_twice", (inp.BASE, inp.RECONNECTS), "SELECT reason, count(*) AS n FROM reconnects GROUP BY reason")

for _name in ("restore_resumed", "restore_after_compaction"):
    SQL[_name] = SQL["restored_edits"]
SQL["restored_counts_after_compaction"] = SQL["rollup_per_minute"]
SQL["repair_then_replay"] = SQL["stream_rollup"]
add(
    "delete_then_replay",
    _M,
    """SELECT event_id, epoch_ms(event_time) AS event_ms, lang, title, sse_id FROM stored
      WHERE NOT (event_time::DATE = (SELECT max(event_time)::DATE FROM stored) AND title IN ('Article 7', 'Article 8'))""",
)
add("seam_restart", _M, "SELECT event_id, epoch_ms(event_time) AS event_ms, lang, title, namespace, is_bot FROM stored")
for _name, _same in (("head", "head"), ("span", "raw_span"), ("bookmark", "latest_bookmark"), ("max_seq", "max_ingest_seq"), ("resume", "resume_state"), ("stored_lag", "stored_lag_last_hour")):
    SQL[f"ledger_{_name}"] = SQL[_same]

for _name in ("24h", "3d", "7d"):
    SQL[f"window_from_tree_{_name}"] = SQL[f"window_from_rollup_{_name}"]
add(
    "page_tree_hours",
    _E,
    "SELECT DISTINCT CAST(epoch(date_trunc('hour', event_time)) AS BIGINT) AS hour_s, lang, namespace, title FROM edits",
)
add("page_tree_days", _E, "SELECT DISTINCT CAST(event_time::DATE AS VARCHAR) AS dt, lang, namespace, title FROM edits")

_LOOKED_AT = """(SELECT CAST(ceil(greatest((SELECT epoch_ms(min(event_time)) FROM edits), epoch_ms(t) + 120000 - 604800000) / 3600000.0) AS BIGINT) * 3600 AS lo,
          (epoch_ms(t) // 1000 - 300) // 3600 * 3600 AS hi FROM head)"""
add(
    "archive_adopted",
    (*_EH, _RAW_HOURS),
    f"""SELECT hour_s, CASE WHEN hour_s // 3600 % 3 = 0 THEN 'written' ELSE 'recorded' END AS result, rows, rows AS recorded
      FROM raw_hours, {_LOOKED_AT} WHERE hour_s >= lo AND hour_s < hi""",
)
add(
    "archive_late_fill",
    (*_EH, _RAW_HOURS),
    f"""SELECT CAST(epoch(date_trunc('hour', event_time)) AS BIGINT) AS hour_s, lang, count(DISTINCT (namespace, title)) AS pages
      FROM edits, {_LOOKED_AT} WHERE epoch(date_trunc('hour', event_time)) >= lo AND epoch(date_trunc('hour', event_time)) < hi GROUP BY 1, 2""",
)
add(
    "archive_states",
    (*_EH, _RAW_HOURS),
    f"""SELECT hour_s, rows, CASE WHEN hour_s // 3600 % 3 = 0 THEN 0 ELSE rows END AS in_file, hour_s // 3600 % 3 = 0 AS due,
      CASE WHEN hour_s // 3600 % 3 = 0 THEN 'write' ELSE 'record' END AS decision
      FROM raw_hours, {_LOOKED_AT} WHERE hour_s >= lo AND hour_s < hi""",
)
