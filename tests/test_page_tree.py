"""Covers of a window by nodes of the page tree, and pages counted through them."""

from __future__ import annotations

import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from conftest import at, edit, frame, ms
from tidemark.config import LANGS, WINDOWS_S
from tidemark.operators import page_tree, rollups, windows
from tidemark.plans import activity, page_sets, upkeep

T0 = at(2026, 10, 4)
SIZES = {"days": 86_400, "hours": 3_600, "minutes": 60}


def test_a_cover_is_exact_and_has_the_fewest_nodes():
    rng = random.Random(1)
    cases = [(0, 0), (60, 120), (0, 86_400), (3_600, 7_200), (86_340, 86_460)]
    cases += [tuple(sorted(rng.randrange(0, 9 * 1_440) * 60 for _ in range(2))) for _ in range(300)]
    for a, b in cases:
        nodes = [(x, name) for name, ranges in page_tree.cover(a, b).items() for lo, hi in ranges for x in range(lo, hi, SIZES[name])]
        covered = sorted(m for x, name in nodes for m in range(x, x + SIZES[name], 60))
        assert covered == list(range(a, b, 60))
        # a minute could be part of a larger node only if that node went beyond the range
        for x, name in nodes:
            for larger in ("hours", "days"):
                start = x // SIZES[larger] * SIZES[larger]
                if SIZES[larger] > SIZES[name]:
                    assert start < a or start + SIZES[larger] > b


@pytest.fixture
def spread(spark):
    rng = random.Random(3)
    moments = [T0 + timedelta(seconds=rng.randrange(9 * 86_400)) for _ in range(400)]
    return [edit(t, title=f"Article {rng.randrange(60)}", lang=rng.choice(LANGS), seq=k, namespace=rng.randrange(2)) for k, t in enumerate(moments)]


def test_windows_count_the_same_pages_through_the_tree(spark, tables, spread):
    edits = frame(spark, spread)
    for k in range(3):  # a page may be in many writes, and in some twice
        page_sets.add_pages(tables, frame(spark, spread[k * 100 : k * 100 + 200]), f"w{k}")
    days = tables.partitions("pages_per_day")
    before = tables.page_sets().hours.count()
    for name in ("pages_per_minute", "pages_per_hour", "pages_per_day"):
        upkeep.compact(tables, name, days[2], ms(T0))
    assert tables.page_sets().hours.count() < before
    for hours_on in (0, 5, 53, 24 * 9 + 1):
        to_ms = ms(T0 + timedelta(hours=hours_on, minutes=17, seconds=3))
        for window_s in (300, 3_600, *WINDOWS_S.values()):
            want = windows.recent_minutes(rollups.pages_per_minute(edits), to_ms, window_s, LANGS).groupBy("lang").agg(F.count_distinct("namespace", "title").alias("pages"))
            got = page_tree.pages_in_window(tables.page_sets(), to_ms, window_s, LANGS)
            assert sorted(got.collect()) == sorted(want.collect())


def test_activity_reads_whole_days_as_days(spark, tables, spread):
    edits = frame(spark, spread)
    page_sets.add_pages(tables, edits, "w")
    to_ms = ms(T0 + timedelta(days=8, hours=2, minutes=30))
    request = activity.parse_request("all", "7d", LANGS)
    rollup = rollups.per_minute(edits)
    by_tree = activity.activity(edits, rollup, tables.page_sets(), request, to_ms + 1_000, to_ms)
    by_minute = activity.activity(edits, rollup, rollups.pages_per_minute(edits), request, to_ms + 1_000, to_ms)
    assert by_tree.collect() == by_minute.collect()
    ranges = page_tree.cover(to_ms // 60_000 * 60 + 60 - 7 * 86_400, to_ms // 60_000 * 60 + 60)
    assert [(b - a) // 86_400 for a, b in ranges["days"]] == [6]
    assert sum(b - a for a, b in ranges["minutes"]) < 2 * 3_600


def test_older_stores_get_their_tree(spark, tables, spread):
    edits = frame(spark, spread)
    for k in range(2):
        part = frame(spark, spread[k * 200 : (k + 1) * 200])
        tables.write_once("pages_per_minute", rollups.with_day(rollups.pages_per_minute(part)), f"w{k}")
    assert page_sets.complete_tree(tables) == 2 and page_sets.complete_tree(tables) == 0
    want = page_tree.per_day(edits)
    assert sorted(tables.page_sets().days.select(*want.columns).distinct().collect()) == sorted(want.collect())


def test_pages_expire_at_every_level(tables, spark, spread):
    page_sets.add_pages(tables, frame(spark, spread), "w")
    dropped = upkeep.expire(tables, ms(T0 + timedelta(days=16)))
    assert dropped["pages_per_day"] == dropped["pages_per_hour"] == dropped["pages_per_minute"] != []


def test_folding_many_days_takes_one_swap_and_pages_read_edits_once(spark, tables, spread, monkeypatch):
    for part in range(2):
        page_sets.add_pages(tables, frame(spark, spread), f"w{part}")
    assert not tables.files.glob(f"{tables.root}/_work/*")
    before = {n: sorted(map(tuple, tables.read(n).drop("token").distinct().collect())) for n in ("pages_per_minute", "pages_per_hour", "pages_per_day")}
    swaps, swap = [], type(tables).swap
    monkeypatch.setattr(type(tables), "swap", lambda self, held, rows, token: (swaps.append(held.name), swap(self, held, rows, token))[1])
    for name in before:
        upkeep.compact_all(tables, name, tables.partitions(name), 1)
    assert sorted(swaps) == sorted(before) and len(tables.partitions("pages_per_day")) > 1
    for name, rows in before.items():
        assert sorted(map(tuple, tables.read(name).drop("token").collect())) == rows
        assert all(t == "compacted-1" for _, t in tables.hold(name, tables.partitions(name)).tokens)
