from __future__ import annotations

import json
from datetime import timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import at, edit, frame, ms, rows, store
from tidemark.config import LANGS, SNAPSHOT_MINUTES
from tidemark.functions import text
from tidemark.operators import hours, lag, quantiles, reconcile, rollups, series, windows
from tidemark.plans import activity as activity_plan
from tidemark.plans import snapshot as snapshot_plan

T = at(2025, 10, 4, 17, 46, 40)
MINUTE = int(T.timestamp()) // 60 * 60


def totals(rows_):
    return {r["lang"]: (r["edits"], r["pages"], r["bot_edits"]) for r in rows_.collect()}


def test_windows_are_half_open_and_end_at_the_newest_event(spark):
    edits = frame(
        spark,
        [
            edit(T, title="a", seq=1),
            edit(T - timedelta(seconds=299.999), title="b", seq=2, bot=True),
            edit(T - timedelta(seconds=300), title="c", seq=3),
            edit(T - timedelta(seconds=5), title="a", seq=4, namespace=2),
            edit(T - timedelta(seconds=5), title="a", seq=5, lang="fr"),
        ],
    )
    assert windows.newest_ms(edits) == ms(T)
    assert totals(windows.window_totals(edits, ms(T), 300, LANGS)) == {"en": (3, 3, 1)}
    assert totals(windows.with_all(windows.window_totals(edits, ms(T), 300, LANGS)))["all"] == (3, 3, 1)
    assert windows.newest_ms(frame(spark, [])) is None
    assert totals(windows.with_all(windows.window_totals(frame(spark, []), ms(T), 300, LANGS))) == {"all": (0, 0, 0)}


def test_preaggregates_count_the_same_pages_as_raw_rows(spark):
    dicts = []
    for i, lang in enumerate(("en", "de", "en", "de", "en")):
        dicts += rows(90, T - timedelta(minutes=40 - i * 7), lang=lang, first_seq=1000 * i)
    edits = frame(spark, dicts)
    to_ms = windows.newest_ms(edits)
    raw = totals(windows.window_totals(edits, to_ms, 86_400, LANGS))
    pre = windows.window_totals_preaggregated(rollups.per_minute(edits), rollups.pages_per_minute(edits), to_ms, 86_400, LANGS)
    assert totals(pre) == raw == {"en": (270, 3, 0), "de": (180, 3, 0)}
    no_sets = windows.window_totals_preaggregated(rollups.per_minute(edits), rollups.pages_per_minute(frame(spark, [])), to_ms, 86_400, LANGS)
    assert totals(no_sets)["en"] == (270, 0, 0)


def test_top_articles_limit_before_the_shuffle(spark):
    edits = frame(spark, rows(100, T - timedelta(seconds=100)) + [edit(T, title="z", namespace=4, seq=900)])
    tops = windows.top_articles(edits, ms(T), 300, 2)
    assert [(r["title"], r["edits"]) for r in tops.orderBy(F.desc("edits"), "title").collect()] == [("Article 0", 34), ("Article 1", 33)]
    plan = tops._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_distinct_pages_are_shuffled_by_page(spark):
    plan = windows.window_totals(frame(spark, []), ms(T), 300, LANGS)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(lang" in plan and "namespace" in plan.split("hashpartitioning(")[2].split(")")[0]


def snapshot_rows(spark, edits, per_minute, gaps=None, to=T):
    got = snapshot_plan.snapshot_langs(edits, per_minute, gaps, ms(to)).collect()
    return {r["lang"]: r.asDict(recursive=True) for r in got}


def chart_edits():
    first = second_minute = []
    first = [edit(T - timedelta(seconds=i % 40), title="Portugal" if i < 7 else "Lisbon", seq=i, bot=i < 2) for i in range(10)]
    second_minute = [edit(T - timedelta(seconds=60 + i % 30), title="Lisboa", lang="pt", seq=100 + i) for i in range(5)]
    return first + second_minute


def test_snapshot_sections(spark):
    edits = frame(spark, chart_edits())
    got = snapshot_rows(spark, edits, rollups.per_minute(edits))
    assert set(got) == {"en", "pt", "de", "all"}
    assert got["all"]["edits_5m"] == 15 and got["all"]["pages_5m"] == 3
    assert got["en"]["bot_share_5m"] == 0.2
    assert got["de"]["edits_5m"] == 0 and got["de"]["bot_share_5m"] is None and got["de"]["top_articles"] == []
    assert [a["title"] for a in got["all"]["top_articles"]] == ["Portugal", "Lisboa", "Lisbon"]
    assert got["all"]["top_articles"][1]["url"] == "https://pt.wikipedia.org/wiki/Lisboa"
    chart = got["all"]["per_minute"]
    assert len(chart) == SNAPSHOT_MINUTES
    assert chart[-1] == {"t": MINUTE, "edits": 10, "partial": True}
    assert chart[-2] == {"t": MINUTE - 60, "edits": 5, "partial": False}
    assert chart[0]["edits"] is None  # nothing known, not zero
    assert got["pt"]["per_minute"][-1]["edits"] == 0  # known, none in pt


def test_gaps_blank_the_minutes_they_touch(spark):
    edits = frame(spark, chart_edits())

    def chart(gap_from, gap_to):
        gaps = spark.createDataFrame([(gap_from, gap_to)], "gap_from TIMESTAMP, gap_to TIMESTAMP")
        return [b["edits"] for b in snapshot_rows(spark, edits, rollups.per_minute(edits), gaps)["all"]["per_minute"]][-2:]

    start = at(1970, 1, 1) + timedelta(seconds=MINUTE)
    assert chart(start - timedelta(seconds=90), start - timedelta(seconds=30)) == [None, 10]
    assert chart(start - timedelta(seconds=90), start) == [None, 10]  # ends where the minute starts
    assert chart(start - timedelta(seconds=90), start + timedelta(milliseconds=1)) == [None, None]
    assert chart(start - timedelta(seconds=120), start - timedelta(seconds=60)) == [5, 10]
    assert chart(start - timedelta(days=2), start + timedelta(days=2)) == [None, None]


def test_snapshot_document(spark):
    edits = frame(spark, chart_edits())
    def body(now, status=None):
        snap = snapshot_plan.snapshot(edits, rollups.per_minute(edits), None, ms(now))
        return json.loads(snapshot_plan.to_document(snap, status).first()["body"])

    live = body(T + timedelta(seconds=2))
    assert (live["status"], live["dataset"], live["window_s"]) == ("live", "wikipedia", 300)
    assert list(live["langs"]) == ["en", "pt", "de", "all"]
    assert live["as_of"] == "2025-10-04T17:46:40.000Z" and live["last_event_age_s"] == 2.0
    assert live["ingest_lag_ms"] == {"p50": 1000, "p95": 1000}
    stale = body(T + timedelta(seconds=61))
    assert stale["status"] == "stale" and stale["last_event_age_s"] == 61.0
    assert body(T, "fallback")["status"] == "fallback"
    empty = snapshot_plan.snapshot(frame(spark, []), rollups.per_minute(frame(spark, [])), None, ms(T))
    doc = json.loads(snapshot_plan.to_document(empty).first()["body"])
    assert doc["status"] == "empty" and doc["langs"] == {} and doc["as_of"] is None and "window_s" not in doc


def test_article_urls(spark):
    def url(lang, title):
        return spark.range(1).select(text.article_url(F.lit(lang), F.lit(title))).first()[0]

    assert url("en", "Python (programming language)") == "https://en.wikipedia.org/wiki/Python_%28programming_language%29"
    assert url("de", "Fußball") == "https://de.wikipedia.org/wiki/Fu%C3%9Fball"
    assert url("en", "A*b~c/d?e") == "https://en.wikipedia.org/wiki/A%2Ab~c%2Fd%3Fe"


def test_paths_name_hours_and_only_real_ones(spark):
    cases = {
        "s3a://b/dt=2026-10-06/hour=09.parquet": 1791277200,
        "/x/dt=2026-10-06/hour=09/part-0001-abc.zstd.parquet": 1791277200,
        "/x/dt=2026-10-06/hour=24.parquet": None,
        "/x/dt=2026-02-30/hour=09.parquet": None,
        "/x/dt=2026-10-06/hour=9.parquet": None,
        "/x/dt=2026-10-06/notes.txt": None,
    }
    got = spark.createDataFrame([(p,) for p in cases], "path STRING").select("path", F.unix_seconds(text.hour_of_path("path")).alias("h"))
    assert {r["path"]: r["h"] for r in got.collect()} == cases


def test_requests():
    parse = activity_plan.parse_request
    assert parse(None, None, LANGS) == activity_plan.Request(LANGS, "5m")
    assert parse("DE, en", " 24H ", LANGS) == activity_plan.Request(("en", "de"), "24h")
    for lang, window in (("fr", "5m"), ("en,fr", "5m"), (",", "5m"), ("en", "2h")):
        with pytest.raises(activity_plan.BadRequest):
            parse(lang, window, LANGS)


def test_activity_forgets_pages_past_their_retention(spark):
    edits = frame(spark, rows(20, T - timedelta(seconds=20), bot_every=4))
    pre, sets = rollups.per_minute(edits), rollups.pages_per_minute(edits)

    def ask(window, now):
        return activity_plan.activity(edits, pre, sets, activity_plan.parse_request("en", window, LANGS), ms(now)).first()

    row = ask("7d", T)
    assert (row["edits"], row["pages_edited"], row["bot_share"]) == (20, 3, 0.25)
    late = ask("7d", T + timedelta(days=7))
    assert late["edits"] == 20 and late["pages_edited"] is None
    assert ask("24h", T + timedelta(days=7))["pages_edited"] == 3
    nothing = activity_plan.activity(frame(spark, []), pre, sets, activity_plan.parse_request("all", "1h", LANGS), ms(T)).first()
    assert (nothing["edits"], nothing["pages_edited"], nothing["bot_share"], nothing["as_of"], nothing["last_event_age_s"]) == (0, 0, None, None, None)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.one_of(st.integers(-5_000, 5_000), st.integers(-(2**62), 2**62), st.sampled_from([4095, 4096, 4097, -4096, -4097])), min_size=1, max_size=80))
def test_quantiles_are_exact(spark, values):
    got = quantiles.exact_quantiles(
        spark.createDataFrame([(v,) for v in values], "v BIGINT"), "v", {"lo": 0.0, "p50": 0.5, "p95": 0.95, "hi": 1.0}
    ).first()
    ordered, n = sorted(values), len(values)
    want = {k: ordered[min(int(p * n), n - 1)] for k, p in {"lo": 0.0, "p50": 0.5, "p95": 0.95, "hi": 1.0}.items()}
    assert got["events"] == n and {k: got[k] for k in want} == want


def test_lag_of_nothing_is_unknown_and_replays_count(spark):
    none = lag.stored_lag(frame(spark, []), ms(T)).first()
    assert (none["events"], none["p50_ms"], none["p95_ms"]) == (0, None, None)
    replayed = frame(spark, [edit(T - timedelta(days=2), seq=i, ingested_at=T) for i in range(3)])
    assert lag.stored_lag(replayed, ms(T + timedelta(seconds=1))).first()["p50_ms"] == 172_800_000


def test_lost_minutes_are_found_and_repaired(spark, tables):
    from tidemark.plans import reconcile as job

    dicts = rows(240, T - timedelta(hours=2), bot_every=3) + rows(120, T - timedelta(hours=2), lang="pt", first_seq=1000)
    store(tables, dicts, "b")
    edits, live = tables.read("edits"), tables.read("edits_per_minute")
    minute = rollups.per_minute(edits).where("lang = 'en'").orderBy("minute").collect()[2]["minute"]
    tables.replace("edits_per_minute", [202510], live.where(~((F.col("minute") == F.lit(minute)) & (F.col("lang") == "en"))).drop("token"), "damage")

    found = job.find_mismatches(tables, ms(T)).collect()
    assert [(r["lang"], r["raw"], r["rolled"]) for r in found] == [("en", 60, 0)]
    sets = tables.read("pages_per_minute").count()
    tables.replace("pages_per_minute", ["2025-10-04"], tables.read("pages_per_minute").where("lang <> 'en'").drop("token"), "damage")
    assert job.repair(tables, job.find_mismatches(tables, ms(T)), ms(T)) == 1
    assert job.find_mismatches(tables, ms(T)).count() == 0
    assert job.repair(tables, job.find_mismatches(tables, ms(T)), ms(T)) == 0
    assert rollups.merge_counts(tables.read("edits_per_minute")).agg(F.sum("edits"), F.sum("bot_edits")).first()[:] == (360, 80)
    topped = rollups.merge_pages(tables.read("pages_per_minute")).where("lang = 'en'")
    assert topped.count() == 3 and sets > 3

    with pytest.raises(job.IngestRunning):
        job.require_quiet(tables, int(windows.newest_ms(edits)) + 2_000)
    mark = job.require_quiet(tables, ms(T))
    store(tables, [edit(T, seq=9000)], "more")
    with pytest.raises(job.IngestRunning):
        job.require_unchanged(tables, mark)


def test_settled_range():
    now = at(2026, 10, 10, 12, 0, 30)
    oldest = int(at(2026, 10, 10, 11, 0, 20).timestamp())
    assert reconcile.settled_range(oldest, ms(now), 900) == (
        int(at(2026, 10, 10, 11, 1).timestamp()),
        int(at(2026, 10, 10, 11, 45).timestamp()),
    )


def test_ledger_keeps_the_newest_record_and_ties_go_up(spark):
    h = T.replace(minute=0, second=0)
    ledger = spark.createDataFrame([(h, 5, T), (h, 9, T), (h, 50, T - timedelta(hours=1))], "hour TIMESTAMP, rows BIGINT, written_at TIMESTAMP")
    assert [r["rows"] for r in hours.recorded_counts(ledger).collect()] == [9]


def test_series_reads_the_current_minute_from_raw(spark):
    edits = frame(spark, chart_edits() + [edit(T + timedelta(seconds=5), seq=77)])
    got = series.edits_per_minute_series(rollups.per_minute(edits), edits, ms(T), 60).collect()
    assert {(r["minute_s"], r["lang"]): r["edits"] for r in got} == {(MINUTE, "en"): 10, (MINUTE - 60, "pt"): 5}
