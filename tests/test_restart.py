"""Ingest begun anew, from each state a store can be in."""

from __future__ import annotations

import json
from datetime import timedelta

import pytest

from conftest import at, edit, frame, ms, store
from tidemark.config import Settings
from tidemark.operators import rollups
from tidemark.schema import LANDED
from tidemark.streaming.restart import pick_up, resume_ingest

NOW = at(2026, 10, 6, 12)
SETTINGS = Settings(flush_interval_s=1)


def ident(k):
    return f"10000000-0000-4000-8000-{k:012d}"


def land(spark, path, ks, start=NOW - timedelta(minutes=90)):
    """Message k happened k minutes after `start` and arrived a second later."""
    out = []
    for k in ks:
        when = start + timedelta(minutes=k)
        body = {"meta": {"id": ident(k), "dt": when.strftime("%Y-%m-%dT%H:%M:%SZ"), "domain": "en.wikipedia.org"}}
        body |= {"wiki": "enwiki", "type": "edit", "namespace": 0, "title": f"Page {k}", "bot": False}
        out.append((k, f"id-{k}", json.dumps(body), when + timedelta(seconds=1)))
    spark.createDataFrame(out, LANDED).coalesce(1).write.mode("append").parquet(path)


def run(tables, path, checkpoint, now=NOW, settings=SETTINGS):
    resume_ingest(tables, path, checkpoint, ms(now), settings, available_now=True).awaitTermination()
    return sorted(int(r["event_id"][-12:]) for r in tables.read("edits").collect())


def test_first_boot_then_bookmark_then_the_same_checkpoint(spark, tables, tmp_path):
    landed = str(tmp_path / "landed")
    land(spark, landed, range(65))
    assert run(tables, landed, str(tmp_path / "c0")) == list(range(30, 65))  # the last hour only
    land(spark, landed, range(65, 69))
    checkpoint = str(tmp_path / "c1")
    assert run(tables, landed, checkpoint) == list(range(30, 69))
    row = pick_up(tables, checkpoint, ms(NOW))
    assert (row["start"], row["bookmark"]) == ("bookmark", "id-64")  # as decided, although more is stored by now
    land(spark, landed, range(69, 72))
    assert run(tables, landed, checkpoint) == list(range(30, 72))
    outcomes = {r["outcome"]: r["n"] for r in tables.read("outcomes").groupBy("outcome").agg({"n": "sum"}).toDF("outcome", "n").collect()}
    assert outcomes == {"kept": 42, "duplicate": 1}  # the bookmark's own message came again
    assert tables.read("ingest_gaps").count() == 0


@pytest.mark.parametrize("times", [1, 2])
def test_a_source_that_forgot_leaves_one_gap(spark, tables, tmp_path, times):
    store(tables, [edit(NOW - timedelta(days=9), sse_id="old")], "t")
    for k in range(times):
        assert pick_up(tables, str(tmp_path / f"c{k}"), ms(NOW + timedelta(minutes=k)))["start"] == "too_old"
    gap = tables.read("ingest_gaps").collect()
    assert len(gap) == 1 and gap[0]["reason"] == "retention"
    assert ms(gap[0]["gap_to"].astimezone()) == ms(NOW + timedelta(minutes=times - 1)) - 3_600_000


def test_rows_from_an_archive_are_replayed_over(spark, tables, tmp_path):
    landed = str(tmp_path / "landed")
    land(spark, landed, range(70))
    store(tables, [edit(NOW - timedelta(minutes=30 - k), title=f"Page {k}", event_id=ident(60 + k), sse_id="") for k in range(4)], "t")
    checkpoint = str(tmp_path / "c")
    assert run(tables, landed, checkpoint) == list(range(33, 70))  # half an hour before the newest row's arrival
    row = pick_up(tables, checkpoint, ms(NOW))
    assert row["start"] == "after_restore" and row["bookmark"] is None
    assert sum(r["edits"] for r in rollups.merge_counts(tables.read("edits_per_minute")).collect()) == 37


def test_counts_without_rows_begin_after_their_last_minute(spark, tables, tmp_path):
    landed = str(tmp_path / "landed")
    counts = rollups.per_minute(frame(spark, [edit(NOW - timedelta(minutes=25))]))
    tables.write_once("edits_per_minute", rollups.with_month(counts), "t")
    land(spark, landed, range(60, 70))
    assert run(tables, landed, str(tmp_path / "c")) == list(range(66, 70))
    gap = tables.read("ingest_gaps").collect()
    assert [(ms(g["gap_from"].astimezone()), ms(g["gap_to"].astimezone())) for g in gap] == [(ms(NOW - timedelta(minutes=25)), ms(NOW - timedelta(minutes=24)))]
