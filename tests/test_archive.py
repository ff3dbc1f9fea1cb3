from __future__ import annotations

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from conftest import at, edit, ms, per_minute, rows, store
from tidemark.config import HOUR_S, Settings
from tidemark.operators.hours import restored_rows
from tidemark.operators.rollups import pages_per_hour
from tidemark.plans import page_sets, resume
from tidemark.plans.archive import Archiver, Refused, archive_status, behind, hour_states
from tidemark.plans.rebuild import ArchiveIncomplete, rebuild
from tidemark.plans.restore import HoursDone, first_raw_day, hour_differences, restore, restore_plan
from tidemark.sources.archive import edits_by_day_and_lang, existing_hours, read_archive
from tidemark.sources.tables import Tables

DAY = at(2026, 10, 6)
H0, H1, H2 = (int((DAY + timedelta(hours=h)).timestamp()) for h in (3, 4, 5))
NOW = DAY + timedelta(days=2)


def second(hour_s, offset=0.0):
    return at(1970, 1, 1) + timedelta(seconds=hour_s + offset)


def archive_day():
    return (
        [edit(second(H0, -4 * HOUR_S), seq=1)]
        + rows(50, second(H0, 10), bot_every=4, first_seq=100)
        + rows(40, second(H1, 10), bot_every=4, first_seq=200)
        + rows(30, second(H2, 10), bot_every=4, first_seq=300)
        + [edit(NOW, seq=400, sse_id="now")]
    )


@pytest.fixture
def archiver(tables, tmp_path):
    store(tables, archive_day(), "day")
    return Archiver(tables, str(tmp_path / "archive"))


def counts(archiver):
    got = read_archive(archiver.tables.spark, archiver.base).groupBy("dt", "hour").count().collect()
    return {(str(r["dt"]), r["hour"]): r["count"] for r in got}


def pages(tables, hours_):
    got = pages_per_hour(tables.read("pages_per_minute")).where(F.col("hour_s").isin(*hours_)).collect()
    return {(r["hour_s"], r["lang"]): r["pages"] for r in got}


def outcomes(run):
    return {r.hour_s: (r.result, r.rows) for r in run if r.hour_s in (H0, H1, H2)}


def decisions(tables, base, now_ms=ms(NOW), **settings):
    found = hour_states(tables, base, now_ms, Settings(**settings)).where(F.col("hour_s").isin(H0, H1, H2)).collect()
    return {r["hour_s"]: r["decision"] for r in found}


def damage(folder):
    for part in folder.glob("*.parquet"):
        crc = folder / f".{part.name}.crc"
        if crc.exists():
            crc.write_bytes(b"")
            crc.unlink()
        part.write_bytes(b"not parquet")


def test_hours_are_written_once_and_again_when_rows_come_late(archiver, tables):
    assert decisions(tables, archiver.base) == {H0: "write", H1: "write", H2: "write"}
    run = archiver.run_once(ms(NOW))
    assert outcomes(run) == {H0: ("written", 50), H1: ("written", 40), H2: ("written", 30)} and behind(run) == []
    assert counts(archiver)[("2026-10-06", "03")] == 50
    assert decisions(tables, archiver.base) == {H0: "none", H1: "none", H2: "none"} and archiver.run_once(ms(NOW)) == []

    rows_ = read_archive(tables.spark, archiver.base).where("hour = '03'").drop("dt", "hour")
    times_ = [r["event_time"] for r in rows_.collect()]
    assert len(rows_.columns) == 9 and times_ == sorted(times_)

    store(tables, [edit(second(H0, 3599.455), title="Late", seq=500)], "late")
    assert decisions(tables, archiver.base) == {H0: "write", H1: "none", H2: "none"}
    assert outcomes(archiver.run_once(ms(NOW) + 1)) == {H0: ("written", 51)}
    status = {r["hour_s"]: (r["rows"], r["in_file"], r["due"]) for r in archive_status(tables, archiver.base, ms(NOW)).collect()}
    assert status[H0] == (51, 51, False)
    table = edits_by_day_and_lang(read_archive(tables.spark, archiver.base), date(2026, 10, 6)).collect()
    assert [(str(r["dt"]), r["lang"], r["edits"]) for r in table] == [("2026-10-06", "en", 121)]


def test_fuller_files_are_recorded_and_never_overwritten_unless_forced(archiver, tables, spark, tmp_path):
    archiver.run_once(ms(NOW))
    thin = Tables(spark, str(tmp_path / "thin"))
    store(thin, [r for r in archive_day() if not second(H0) <= r["event_time"] < second(H0, 30)], "day")
    other = Archiver(thin, archiver.base)
    assert decisions(thin, archiver.base) == {H0: "record", H1: "record", H2: "record"}
    assert outcomes(other.run_once(ms(NOW))) == {H0: ("recorded", 50), H1: ("recorded", 40), H2: ("recorded", 30)}
    assert counts(archiver)[("2026-10-06", "03")] == 50
    assert page_sets.unfilled_hours(thin, archiver.base, ms(NOW)).count() == 0
    assert pages(thin, [H0]) == pages(tables, [H0])  # completed from the fuller file

    # a record older than the file: raw has more than the record says, but not more than the file
    thin.files.remove(thin.path("archive_hours"))
    from tidemark.plans.logs import record_archived
    from tidemark.operators.hours import hours_frame

    record_archived(thin, hours_frame(spark, [H0]).withColumn("rows", F.lit(10).cast("bigint")), ms(NOW), "old")
    assert decisions(thin, archiver.base)[H0] == "record"

    with pytest.raises(Refused):
        other.force(H0 - HOUR_S, ms(NOW))
    forced = other.force(H0, ms(NOW))
    assert (forced.result, forced.rows) == ("written", 30) and counts(archiver)[("2026-10-06", "03")] == 30
    assert outcomes(archiver.run_once(ms(NOW) + 1)) == {}  # its own record still covers raw: a lost file is not looked for


def test_which_hours_are_looked_at(tables, tmp_path):
    base = str(tmp_path / "archive")
    start = second(H0)
    store(tables, [edit(start + timedelta(seconds=0.5), seq=1), edit(second(H1, 60), seq=2), edit(second(H2, 400), seq=3)], "a")
    assert decisions(tables, base) == {H1: "write"}  # rows begin half a second into H0; ingest may still add to H2
    assert decisions(tables, base, ms(second(H2, 1800)), lookback_s=3600) == {}  # the look-back cuts part way into H1
    assert decisions(Tables(tables.spark, base + "-none"), base) == {}


def test_an_unreadable_file_holds_up_no_other_hour(archiver, tables, spark, tmp_path):
    archiver.run_once(ms(NOW))
    fresh = Tables(spark, str(tmp_path / "fresh"))
    store(fresh, archive_day(), "day")
    damage(tmp_path / "archive" / "dt=2026-10-06" / "hour=04")
    from tidemark.sources.archive import file_states

    assert {r["hour_s"]: (r["in_file"], r["readable"]) for r in file_states(spark, archiver.base, [H0, H1, H2]).collect()} == {H0: (50, True), H1: (0, False), H2: (30, True)}
    run = Archiver(fresh, archiver.base).run_once(ms(NOW))
    assert outcomes(run) == {H0: ("recorded", 50), H1: ("unreadable", 0), H2: ("recorded", 30)} and behind(run) == [H1]
    assert Archiver(fresh, archiver.base).force(H1, ms(NOW)).rows == 40


def test_pages_are_completed_from_the_fuller_side(archiver, tables):
    archiver.run_once(ms(NOW))
    want = pages(tables, [H0, H1, H2])
    for name in ("pages_filled", "pages_per_minute"):
        tables.files.remove(tables.path(name))
    assert decisions(tables, archiver.base) == {H0: "fill", H1: "fill", H2: "fill"}
    held = tables.read("edits").where(F.unix_seconds("event_time") % 2 == 0).drop("token")
    tables.replace("edits", tables.partitions("edits"), held, "thinned")
    run = archiver.run_once(ms(NOW))
    assert outcomes(run) == {H0: ("filled", 50), H1: ("filled", 40), H2: ("filled", 30)}
    assert pages(tables, [H0, H1, H2]) == want


def test_a_failing_hour_is_found_by_halving(archiver, monkeypatch):
    from tidemark.plans import archive

    real = archive.write_hours

    def fails(rows_, base):
        if not rows_.where((F.unix_seconds("event_time") >= H1) & (F.unix_seconds("event_time") < H2)).isEmpty():
            raise RuntimeError("executor lost")
        return real(rows_, base)

    monkeypatch.setattr(archive, "write_hours", fails)
    run = archiver.run_once(ms(NOW))
    assert outcomes(run) == {H0: ("written", 50), H1: ("error", 0), H2: ("written", 30)} and behind(run) == [H1]
    monkeypatch.setattr(archive, "write_hours", real)
    assert outcomes(archiver.run_once(ms(NOW) + 1)) == {H1: ("written", 40)}


def test_rebuild_from_the_archive(archiver, tables, spark, tmp_path):
    archiver.run_once(ms(NOW))
    before = per_minute(tables)
    whole_day = (date(2026, 10, 6), date(2026, 10, 7))
    with pytest.raises(ArchiveIncomplete, match="21 hour"):
        rebuild(tables, archiver.base, *whole_day, ms(NOW) + 60_000)
    with pytest.raises(ValueError):
        rebuild(tables, archiver.base, date(2026, 9, 1), date(2026, 10, 7), ms(NOW) + 60_000)

    lost = tables.read("edits_per_minute").where("minute < timestamp'2026-10-06' OR minute >= timestamp'2026-10-07'")
    tables.replace("edits_per_minute", [202610], lost.drop("token"), "damage")
    assert per_minute(tables) != before
    n = rebuild(tables, archiver.base, *whole_day, ms(NOW) + 60_000, allow_missing=True)
    assert per_minute(tables) == before
    assert n == len([m for m in before if m[0].day == 6])
    assert rebuild(tables, archiver.base, *whole_day, ms(NOW) + 61_000, allow_missing=True) == n
    assert per_minute(tables) == before

    # a file that doesn't hold the rows recorded for it is refused, and nothing changes
    from tidemark.plans.logs import record_archived
    from tidemark.operators.hours import hours_frame

    record_archived(tables, hours_frame(spark, [H1]).withColumn("rows", F.lit(41).cast("bigint")), ms(NOW) + 62_000, "wrong")
    with pytest.raises(ArchiveIncomplete, match="recorded"):
        rebuild(tables, archiver.base, *whole_day, ms(NOW) + 63_000, allow_missing=True)
    assert per_minute(tables) == before


@pytest.fixture
def lost(tables, spark, tmp_path):
    """An archive of hours days apart, what the store held of them, and an empty store."""
    old = second(H0, 10) - timedelta(days=3)
    store(tables, archive_day() + [edit(old - timedelta(hours=2), seq=5000)] + rows(20, old, first_seq=6000), "day")
    archiver = Archiver(tables, str(tmp_path / "archive"))
    hours = sorted(r.hour_s for r in archiver.run_once(ms(NOW)))
    return archiver.base, hours, Tables(spark, str(tmp_path / "empty")), tables


def stored_state(t, hours):
    ids = sorted(r["event_id"] for r in t.read("edits").select("event_id").collect())
    return ids, [m for m in per_minute(t) if int(m[0].timestamp()) // HOUR_S * HOUR_S in hours], pages(t, set(hours))


def test_a_store_with_ingested_rows_has_lost_nothing(lost):
    base, _, _, full = lost
    assert restore_plan(full, base, ms(NOW)).isEmpty() and restore(full, base, ms(NOW)) == HoursDone()


def test_an_empty_store_comes_back_by_hours(lost):
    base, hours, empty, full = lost
    done = restore(empty, base, ms(NOW))
    raw_from = int(at(2026, 10, 5).timestamp())
    assert done.raw == tuple(h for h in hours if h >= raw_from) and done.counts == tuple(h for h in hours if h < raw_from)
    ids, counted, sets = stored_state(empty, hours)
    assert len(ids) == done.rows == 121
    assert (counted, sets) == stored_state(full, hours)[1:]
    assert {t for _, t in empty.hold("edits", empty.partitions("edits")).tokens} == {f"restored-{second(h, 0):%Y%m%d%H}" for h in done.raw}
    assert restore(empty, base, ms(NOW)) == HoursDone()

    state = resume.resume_state(empty.read("edits"), empty.read("edits_per_minute"), ms(NOW)).first()
    assert state == resume.resume_state(None, empty.read("edits_per_minute"), ms(NOW), ledger=empty.ledger()).first()
    assert state["start"] == "after_restore" and state["bookmark"] is None
    assert state["since_ms"] == ms(second(H2, 10 + 29 + 1) - timedelta(minutes=30))
    assert state["floor_ms"] == ms(at(2026, 10, 5))


def test_what_a_cut_off_or_folded_run_left_is_completed(lost, monkeypatch):
    from tidemark.plans import upkeep

    base, hours, empty, full = lost
    real = Tables.put

    def cut_off(self, name, some, token):
        if name == "edits_per_minute" and self is empty and self.partitions("edits"):
            raise RuntimeError("executor lost")
        return real(self, name, some, token)

    monkeypatch.setattr(Tables, "put", cut_off)
    with pytest.raises(RuntimeError, match="executor lost"):
        restore(empty, base, ms(NOW))
    monkeypatch.setattr(Tables, "put", real)
    again = restore(empty, base, ms(NOW))
    want = stored_state(full, hours)[1:]
    assert again.raw == () and stored_state(empty, hours)[1:] == want  # rows were whole, their counts weren't

    # a fold puts hours under one token; then an hour is lost, one loses a row, one holds a row twice
    day = "2026-10-06"
    upkeep.compact(empty, "edits", day, ms(NOW))
    upkeep.compact(empty, "edits_per_minute", "202610", ms(NOW))
    held = empty.read("edits").where("dt = date'2026-10-06'").drop("token")
    damaged = held.where(F.unix_seconds("event_time") >= H1)
    one = damaged.where(F.unix_seconds("event_time") < H2).limit(1)
    empty.replace("edits", [day], damaged.join(one.select("event_id"), "event_id", "left_anti").unionByName(held.where(F.unix_seconds("event_time") >= H2).limit(1)), "restored")
    plan = {r["hour_s"]: r["target"] for r in restore_plan(empty, base, ms(NOW)).collect()}
    assert plan == {H0: "raw", H1: "raw", H2: "raw"}
    done = restore(empty, base, ms(NOW))
    assert set(done.raw) == {H0, H1, H2} and len(stored_state(empty, hours)[0]) == 121
    assert stored_state(empty, hours)[1:] == want
    assert restore(empty, base, ms(NOW)) == HoursDone()


def test_hours_differ_by_content_not_by_order(lost, spark):
    base, _, _, _ = lost
    files = read_archive(spark, base)
    assert hour_differences(files, files.orderBy(F.desc("event_id"))).isEmpty()
    renamed = files.withColumn("title", F.when(F.unix_seconds("event_time") >= H2, F.concat("title", F.lit("x"))).otherwise(F.col("title")))
    assert {r["hour_s"] for r in hour_differences(files, renamed).collect()} == {H2}
    twice = files.unionByName(files.where(F.unix_seconds("event_time") >= H2))
    assert {r["hour_s"] for r in hour_differences(files, twice).collect()} == {H2}
    assert hour_differences(files.where("false"), files).isEmpty()  # hours without files are none of its business


def test_raw_rows_come_back_for_the_newest_days_that_are_kept():
    newest = int(at(2026, 10, 10, 9).timestamp())
    assert first_raw_day(newest, ms(at(2026, 10, 10, 11))) == date(2026, 10, 9)
    assert first_raw_day(int(at(2026, 10, 3, 9).timestamp()), ms(at(2026, 10, 10, 11))) == date(2026, 10, 4)


def test_restored_rows_carry_no_stream_id(archiver, spark):
    archiver.run_once(ms(NOW))
    row = restored_rows(read_archive(spark, archiver.base)).first()
    assert row["sse_id"] == "" and row["ingest_seq"] == int(row["ingested_at"].timestamp() * 1000) * 1_000_000


def test_listing_reads_paths_only(archiver, spark):
    archiver.run_once(ms(NOW))
    found = existing_hours(spark, archiver.base, [date(2026, 10, 6)])
    assert {r["hour_s"] for r in found.collect()} == {H0, H1, H2}
    assert "ReadSchema: struct<path:string>" in found._jdf.queryExecution().toString()
