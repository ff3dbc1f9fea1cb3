from __future__ import annotations

import json
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from conftest import at, edit, frame, ms, rows, store
from tidemark.config import Settings
from tidemark.functions import bookmark, status
from tidemark.operators import costs, gaps, lag, rollups, slo
from tidemark.plans import logs, ops_report, resume, snapshot, upkeep

NOW = at(2026, 10, 29, 14, 20, 30)
MINUTE_NOW = int(NOW.timestamp()) - 30
OCTOBER = int(at(2026, 10, 1).timestamp())
SAMPLE = "minute TIMESTAMP, sampled_at TIMESTAMP, age_s DOUBLE"
COST = "fetched_at TIMESTAMP, ok BOOLEAN, period_start DATE, period_end DATE, amount STRING, currency STRING, estimated BOOLEAN, error STRING"
GAP = "detected_at TIMESTAMP, gap_from TIMESTAMP, gap_to TIMESTAMP, reason STRING"


def window(spark, now, first_ms):
    first = spark.createDataFrame([(first_ms, 1)], "first_ms BIGINT, n BIGINT")
    return slo.slo_window(first, ms(now)).first()


def test_slo_windows(spark):
    long_ago = (MINUTE_NOW - 90 * 86_400) * 1000
    win = window(spark, NOW, long_ago)
    assert (win["start_s"], win["end_s"], win["month_s"], win["month_days"], win["full_window"]) == (OCTOBER, MINUTE_NOW, OCTOBER, 31, True)
    assert win["minutes"] == (MINUTE_NOW - OCTOBER) // 60
    november = window(spark, at(2026, 11, 1, 0, 0, 30), long_ago)
    assert (november["minutes"], november["month_days"], november["full_window"]) == (0, 30, True)
    part = window(spark, NOW, (MINUTE_NOW - 7_200 + 17) * 1000)
    assert (part["start_s"], part["minutes"], part["full_window"]) == (MINUTE_NOW - 7_200 + 60, 119, False)
    assert window(spark, NOW, (MINUTE_NOW - 600) * 1000)["minutes"] == 10
    assert window(spark, NOW, (MINUTE_NOW + 5) * 1000)["minutes"] == 0
    assert window(spark, NOW, None)["start_s"] is None
    assert window(spark, at(2028, 2, 10), long_ago)["month_days"] == 29


def summary(spark, minutes, sampled, fresh, target, days=30):
    whole = F.struct(
        F.lit(0).cast("bigint").alias("start_s"), F.lit(minutes * 60).cast("bigint").alias("end_s"), F.lit(0).cast("bigint").alias("month_s"),
        F.lit(days).alias("month_days"), F.lit(minutes).cast("bigint").alias("minutes"), F.lit(True).alias("full_window"),
    )
    counted = spark.range(1).select(F.lit(sampled).cast("bigint").alias("sampled"), F.lit(fresh).cast("bigint").alias("fresh"), whole.alias("w"))
    return slo.summarise(counted, target, 60.0).first()


def test_slo_summaries(spark):
    r = summary(spark, 100, 90, 88, 0.99)
    assert (r["fresh"], r["stale"], r["unmeasured"], r["ratio"], r["met"], r["budget_used"]) == (88, 2, 10, 0.88, False, 12)
    r = summary(spark, 60, 0, 0, 0.99)
    assert (r["unmeasured"], r["ratio"], r["met"]) == (60, 0.0, False)
    assert summary(spark, 1_000, 1_000, 990, 0.99)["met"] is True
    assert summary(spark, 1_000, 1_000, 989, 0.99)["met"] is False
    r = summary(spark, 10, 12, 12, 0.99)
    assert (r["fresh"], r["stale"], r["unmeasured"], r["ratio"]) == (10, 0, 0, 1.0)
    r = summary(spark, 0, 0, 0, 0.999)
    assert (r["ratio"], r["met"]) == (None, None)


@pytest.mark.parametrize(("days", "target", "budget"), [(30, 0.99, 432), (28, 0.999, 40), (29, 0.999, 42), (30, 0.999, 43), (31, 0.999, 45)])
def test_budgets(spark, days, target, budget):
    assert spark.range(1).select(slo.budget_minutes(F.lit(days), target)).first()[0] == budget


def test_a_minute_is_fresh_only_if_every_sample_was(spark):
    start = at(2026, 10, 29, 10)
    m = [start + timedelta(minutes=i) for i in range(6)]
    samples = spark.createDataFrame([(m[0], m[0], 2.5), (m[1], m[1], 75.0), (m[2], m[2], None), (m[4], m[4], 1.0), (m[4], m[4], 61.0), (m[5], m[5], 59.9)], SAMPLE)
    s = int(start.timestamp())
    assert slo.freshness(samples, 60.0, s, s + 360).first()[:] == (5, 2)


@pytest.mark.parametrize(("newest", "stored", "state"), [(2, 1, "live"), (60, 1, "live"), (172_800, 1, "catching_up"), (172_800, 61, "paused"), (61, 61, "paused"), (None, None, "empty")])
def test_ingest_states(spark, newest, stored, state):
    now = ms(NOW)
    values = [F.lit(None if age is None else now - age * 1000).cast("bigint") for age in (newest, stored)]
    assert spark.range(1).select(status.ingest_state(*values, now, 60.0)).first()[0] == state


@pytest.mark.parametrize(("hours_ago", "ok", "today"), [(None, None, "pending"), (1, True, "ok"), (1, False, "failed"), (24, True, "pending"), (24, False, "pending")])
def test_cost_checks(spark, hours_ago, ok, today):
    at_ms = F.lit(None if hours_ago is None else ms(NOW) - hours_ago * 3_600_000).cast("bigint")
    assert spark.range(1).select(status.cost_check(at_ms, F.lit(ok).cast("boolean"), ms(NOW))).first()[0] == today


REAL_ID = '[{"topic":"eqiad.mediawiki.recentchange","partition":0,"timestamp":1791498391744},{"topic":"codfw.mediawiki.recentchange","partition":0,"offset":-1}]'


def test_bookmarks_are_shortened_or_left_out(spark):
    odd = '[{"topic":"eqiad.x","timestamp":true},{"topic":"codfw.x","timestamp":99999999999999999999},{"topic":"other.x","offset":false}]'
    cases = [REAL_ID, odd, "not json", "{}", "[1]", '[{"partition":0}]']
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i INT, id STRING").select("i", bookmark.shorten("id").alias("b"))
    got = [r["b"] for r in df.orderBy("i").collect()]
    assert [tuple(p) for p in got[0]["positions"]] == [("eqiad", "2026-10-08T22:26:31.744Z", None), ("codfw", None, -1)]
    assert got[0]["bytes"] == len(REAL_ID)
    assert [(p["at"], p["offset"]) for p in got[1]["positions"]] == [(None, None)] * 3
    assert got[2:] == [None] * 4


def month_of_costs(spark):
    return spark.createDataFrame(
        [
            (at(2026, 9, 30, 1), True, date(2026, 9, 1), date(2026, 10, 1), "9.99", "USD", False, ""),
            (at(2026, 10, 28, 1), True, date(2026, 10, 1), date(2026, 10, 29), "0.1977203052", "USD", True, ""),
            (at(2026, 10, 29, 1), False, date(2026, 10, 1), date(2026, 10, 30), "", "", False, "denied for account 1"),
        ],
        COST,
    )


def test_the_figure_is_this_months_newest_good_one(spark):
    row = costs.cost_figure(month_of_costs(spark), date(2026, 10, 1)).first()
    assert (row["attempts"], row["figures"], row["last_ok"], row["fig_amount"], row["fig_estimated"]) == (3, 1, False, "0.1977203052", True)
    assert row["fetched_ms"] == ms(at(2026, 10, 29, 1)) and row["figure_ms"] == ms(at(2026, 10, 28, 1))
    assert costs.cost_figure(month_of_costs(spark), date(2026, 11, 1)).first()["fig_amount"] is None
    assert costs.recorded_on(month_of_costs(spark), ms(NOW)).first()["n"] == 1


def test_cost_answers(spark):
    month = {"Total": {"UnblendedCost": {"Amount": "0.1977203052", "Unit": "USD"}}, "Estimated": True}
    answers = [{"ResultsByTime": [month]}, {"ResultsByTime": [month, month]}, {}, {"ResultsByTime": [{"Total": {}}]}]
    df = spark.createDataFrame([(NOW, json.dumps(a)) for a in answers] + [(NOW, "{broken")], "fetched_at TIMESTAMP, response STRING")
    got = costs.parse_answers(df).collect()
    assert (got[0]["ok"], got[0]["amount"], got[0]["currency"], got[0]["estimated"]) == (True, "0.1977203052", "USD", True)
    assert (got[0]["period_start"], got[0]["period_end"]) == (date(2026, 10, 1), date(2026, 10, 30))
    assert [r["ok"] for r in got[1:]] == [False] * 4
    assert got[1]["error"] == "expected one month of results, got 2" and got[2]["error"].endswith("got 0")


def test_gap_lists(spark):
    start = NOW - timedelta(days=3)
    many = [(NOW, start + timedelta(minutes=i), start + timedelta(minutes=i, seconds=90), "retention") for i in range(25)]
    many += [(NOW, NOW - timedelta(days=40), NOW - timedelta(days=39), "old"), (NOW, NOW, NOW - timedelta(seconds=5), "backwards")]
    got = gaps.gaps_with_total(spark.createDataFrame(many, GAP), ms(NOW)).collect()
    assert len(got) == 20 and {r["total"] for r in got} == {26}
    assert (got[0]["reason"], got[0]["duration_s"], got[1]["duration_s"]) == ("backwards", 0, 90)


def ops(spark, edits, reconnects=(), samples=(), holes=(), cost_rows=None):
    report = ops_report.ops_report(
        edits,
        spark.createDataFrame(list(reconnects), "at TIMESTAMP, reason STRING"),
        spark.createDataFrame(list(samples), SAMPLE),
        spark.createDataFrame(list(holes), GAP),
        spark.createDataFrame([], COST) if cost_rows is None else cost_rows,
        ms(NOW),
    )
    return json.loads(snapshot.to_document(report).first()["body"])


def test_nothing_measured_is_unknown_not_zero(spark):
    doc = ops(spark, frame(spark, []))
    assert doc["ingest"]["state"] == "empty" and doc["ingest"]["newest_event_at"] is None
    assert doc["ingest"]["lag_ms"] == {"p50": None, "p95": None, "events": 0, "window_s": 3600}
    assert doc["ingest"]["bookmark"] is None
    assert doc["ingest"]["reconnects"] == {"window_s": 86400, "total": 0, "by_reason": {}}
    fresh = doc["freshness"]
    assert (fresh["from"], fresh["ratio"], fresh["met"], fresh["minutes"], fresh["month"], fresh["budget_minutes"]) == (None, None, None, 0, "2026-10", 45)
    assert doc["gaps"] == {"window_days": 30, "total": 0, "recent": []}
    assert doc["cost"] is None and doc["cost_check"] == {"today": "pending", "last_attempt_at": None}


def test_the_report_shows_what_it_was_given(spark):
    edits = frame(spark, [edit(NOW - timedelta(seconds=5), seq=2, sse_id=REAL_ID), edit(NOW - timedelta(seconds=9), seq=1)])
    drops = [(NOW - timedelta(hours=1), "idle"), (NOW - timedelta(hours=2), "idle"), (NOW - timedelta(days=2), "eof")]
    start = at(1970, 1, 1) + timedelta(seconds=MINUTE_NOW - 120)
    samples = [(start, start, 1.0), (start + timedelta(minutes=1), start + timedelta(minutes=1), 70.0)]
    hole = (NOW, NOW - timedelta(hours=3), NOW - timedelta(hours=2), "retention")
    doc = ops(spark, edits, drops, samples, [hole], month_of_costs(spark))
    assert doc["ingest"]["state"] == "live" and doc["ingest"]["reconnects"]["by_reason"] == {"idle": 2}
    assert doc["ingest"]["bookmark"]["positions"][0]["stream"] == "eqiad"
    assert doc["ingest"]["lag_ms"]["p50"] == 1000
    assert (doc["freshness"]["minutes"], doc["freshness"]["fresh"], doc["freshness"]["stale"], doc["freshness"]["ratio"]) == (2, 1, 1, 0.5)
    assert doc["gaps"]["recent"][0]["duration_s"] == 3600
    assert doc["cost"]["amount"] == "0.1977203052" and doc["cost"]["period_end"] == "2026-10-29"
    assert doc["cost_check"]["today"] == "failed" and "denied" not in json.dumps(doc)


def state(edits, per_minute=None, now=NOW, **settings):
    per_minute = rollups.per_minute(edits) if per_minute is None else per_minute
    return resume.resume_state(edits, per_minute, ms(now), Settings(**settings)).first()


def test_resume_states(spark):
    empty = frame(spark, [])
    s = state(empty)
    assert (s["start"], s["since_ms"], s["gap_from_ms"], s["last_seq"]) == ("first_boot", ms(NOW) - 3_600_000, None, 0)

    late = rows(20, NOW - timedelta(seconds=60), first_seq=1) + [edit(NOW - timedelta(days=2), seq=500, sse_id="the-late-one")]
    s = state(frame(spark, late))
    assert (s["start"], s["bookmark"], s["last_seq"], s["since_ms"], s["gap_from_ms"]) == ("bookmark", "the-late-one", 500, None, None)

    old = frame(spark, rows(5, NOW - timedelta(hours=2)))
    s = state(old, source_retention_s=3_600, first_boot_lookback_s=1_800)
    assert (s["start"], s["bookmark"], s["since_ms"], s["gap_to_ms"]) == ("too_old", None, ms(NOW) - 1_800_000, ms(NOW) - 1_800_000)
    assert s["gap_from_ms"] % 60_000 == 0

    minutes = rollups.per_minute(frame(spark, rows(10, NOW - timedelta(days=9))))
    s = state(empty, minutes)
    assert s["start"] == "after_rollup" and s["since_ms"] == s["gap_to_ms"] == ms(NOW) - 7 * 86_400_000
    assert s["gap_from_ms"] % 60_000 == 0 and s["gap_from_ms"] < s["since_ms"]
    last = (NOW - timedelta(minutes=50)).replace(second=0)
    minutes = rollups.per_minute(frame(spark, [edit(last)]))
    s = state(empty, minutes)
    assert s["since_ms"] == s["floor_ms"] == ms(last) + 60_000 and (s["gap_from_ms"], s["gap_to_ms"]) == (ms(last), ms(last) + 60_000)

    restored = frame(spark, [edit(NOW - timedelta(days=10), sse_id="", ingested_at=NOW - timedelta(days=10))])
    s = state(restored, source_retention_s=20 * 86_400)
    assert s["start"] == "after_restore" and s["gap_from_ms"] is None and s["floor_ms"] == ms(NOW.replace(hour=0, minute=0, second=0) - timedelta(days=10))


def test_an_aged_bookmark_expires_with_a_gap(spark):
    live = resume.resume_state(frame(spark, rows(5, NOW - timedelta(hours=1), first_seq=1)), rollups.per_minute(frame(spark, [])), ms(NOW))
    assert resume.expired_bookmark(live, ms(NOW)).count() == 0
    later = resume.expired_bookmark(live, ms(NOW + timedelta(days=8))).first()
    assert later["gap_to_ms"] == later["since_ms"] == ms(NOW + timedelta(days=8)) - 3_600_000
    assert later["gap_from_ms"] % 60_000 == 0


def test_logs_are_keyed_appends(spark, tables):
    drops = spark.createDataFrame([(NOW, "idle")], "at TIMESTAMP, reason STRING")
    for token in ("a", "a", "b"):
        logs.record_reconnects(tables, drops, token)
    assert lag.reconnects_by_reason(tables.read("ingest_reconnects"), ms(NOW)).first()[:] == ("idle", 2)
    logs.record_sample(tables, ms(NOW))
    assert tables.read("freshness_samples").first()["age_s"] is None
    store(tables, [edit(NOW - timedelta(seconds=30))], "e")
    logs.record_sample(tables, ms(NOW) + 1_000)
    sample = tables.read("freshness_samples").collect()
    assert len(sample) == 1 and sample[0]["age_s"] == 31.0
    first = resume.resume_state(frame(spark, rows(5, NOW - timedelta(days=9))), rollups.per_minute(frame(spark, [])), ms(NOW))
    logs.record_gaps(tables, resume.gap_row(first, ms(NOW)), "g")
    assert tables.read("ingest_gaps").first()["reason"] == "retention"


def test_upkeep(spark, tables):
    old, new = NOW - timedelta(days=20), NOW - timedelta(minutes=10)
    for i, start in enumerate((old, new, new + timedelta(seconds=5))):
        store(tables, rows(30, start, bot_every=2, first_seq=100 * i), f"w{i}")
    before = {tuple(r) for r in rollups.merge_counts(tables.read("edits_per_minute")).collect()}
    sets = {tuple(r) for r in rollups.merge_pages(tables.read("pages_per_minute")).collect()}
    for _ in range(2):  # rerunnable
        upkeep.compact(tables, "edits_per_minute", "202610", ms(NOW))
        upkeep.compact(tables, "pages_per_minute", "2026-10-29", ms(NOW))
        upkeep.compact(tables, "edits", "2026-10-29", ms(NOW))
    assert {tuple(r) for r in rollups.merge_counts(tables.read("edits_per_minute")).collect()} == before
    assert {tuple(r) for r in rollups.merge_pages(tables.read("pages_per_minute")).collect()} == sets
    assert tables.read("edits_per_minute").count() == len(before) and tables.read("edits").count() == 90
    assert len(tables.files.children(f"{tables.path('edits')}/dt=2026-10-29", "token")) == 1

    assert upkeep.expired_partitions(tables, "edits", ms(NOW)) == ["2026-10-09"]
    samples = spark.createDataFrame([(old - timedelta(days=90), old - timedelta(days=90), 1.0), (new, new, 2.0)], SAMPLE)
    tables.write_once("freshness_samples", samples, "s")
    dropped = upkeep.expire(tables, ms(NOW))
    assert dropped["edits"] == dropped["pages_per_minute"] == ["2026-10-09"] and dropped["edits_per_minute"] == []
    assert tables.read("edits").count() == 60 and tables.read("freshness_samples").count() == 1
    assert rollups.merge_counts(tables.read("edits_per_minute")).agg(F.sum("edits")).first()[0] == 90

    upkeep.delete_rows(tables, "edits", "2026-10-29", F.col("is_bot"), ms(NOW))
    assert tables.read("edits").count() == 30

    ledger = spark.createDataFrame([(NOW, 5, old), (NOW, 9, new)], "hour TIMESTAMP, rows BIGINT, written_at TIMESTAMP")
    tables.write_once("archive_hours", ledger, "l")
    upkeep.compact_log(tables, "archive_hours", ms(NOW))
    assert [r["rows"] for r in tables.read("archive_hours").collect()] == [9]


def test_a_swap_cut_off_half_way_is_finished_later(tables, monkeypatch):
    store(tables, rows(30, NOW - timedelta(minutes=10)), "w")
    want = rollups.merge_counts(tables.read("edits_per_minute"))
    merged = rollups.with_month(want)
    monkeypatch.setattr(type(tables), "finish_replace", lambda self, name: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        tables.replace("edits_per_minute", [202610], merged.withColumn("edits", F.lit(7).cast("bigint")), "new")
    assert tables.read("edits_per_minute").agg(F.sum("edits")).first()[0] == 30  # live rows untouched
    monkeypatch.undo()
    tables.finish_replace("edits_per_minute")
    assert {r["edits"] for r in tables.read("edits_per_minute").collect()} == {7}


def test_a_batch_written_during_a_swap_stays(tables, monkeypatch):
    for i in range(3):
        store(tables, rows(30, NOW - timedelta(minutes=10), first_seq=100 * i), f"run-{i:09d}")
    whole = type(tables).finish_replace

    def late(self, name):
        if self.files.exists(f"{self.root}/_staged/{name}/_SUCCESS"):
            store(self, rows(30, NOW - timedelta(minutes=5), first_seq=900), "run-000000003")
        whole(self, name)

    monkeypatch.setattr(type(tables), "finish_replace", late)
    upkeep.compact(tables, "edits", "2026-10-29", ms(NOW))
    tokens = tables.files.children(f"{tables.path('edits')}/dt=2026-10-29", "token")
    assert tables.read("edits").count() == 120
    assert tokens == [f"compacted-{ms(NOW)}", "run-000000002", "run-000000003"]  # a replay of the newest batch finds its own token


@pytest.mark.parametrize("step", ["staged", "written", "half removed"])
def test_a_log_rewrite_cut_off_at_any_step_is_resumed(spark, tables, monkeypatch, step):
    def append(rows_, token):
        tables.write_once("archive_hours", spark.createDataFrame(rows_, "hour TIMESTAMP, rows BIGINT, written_at TIMESTAMP"), token)

    append([(NOW, 5, NOW)], "a")
    append([(NOW, 9, NOW + timedelta(hours=1))], "b")
    removed = []

    def stop(*_):
        raise RuntimeError("lost")

    def remove_one(self, path):
        if removed:
            stop()
        removed.append(path)
        real_remove(self, path)

    kind, real_remove = type(tables.files), type(tables.files).remove
    if step == "staged":
        monkeypatch.setattr(type(tables), "write_once", stop)
    else:
        monkeypatch.setattr(kind, "remove", stop if step == "written" else remove_one)
    with pytest.raises(RuntimeError, match="lost"):
        upkeep.compact_log(tables, "archive_hours", ms(NOW))
    monkeypatch.undo()
    append([(NOW + timedelta(hours=1), 3, NOW)], "c")
    upkeep.compact_log(tables, "archive_hours", ms(NOW) + 1)
    assert sorted(r["rows"] for r in tables.read("archive_hours").collect()) == [3, 9]


def test_shares_round_by_the_exact_double(spark):
    from tidemark.functions.ratios import rounded

    values = [p / q for q in (160, 20_000, 2_000_000, 7, 32, 64) for p in range(0, q + 1, max(1, q // 3_001))]
    frame_ = spark.createDataFrame([(v,) for v in values], "v DOUBLE").select("v", rounded(F.col("v"), 4).alias("four"), rounded(F.col("v"), 6).alias("six"))
    assert [(r["four"], r["six"]) for r in frame_.collect()] == [(round(r, 4), round(r, 6)) for r in values]
