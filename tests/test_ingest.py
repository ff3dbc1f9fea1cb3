from __future__ import annotations

import json
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from conftest import at, edit, frame, ms, rows, store
from tidemark.config import Settings
from tidemark.operators import rollups, seam
from tidemark.operators.classify import classify
from tidemark.schema import LANDED
from tidemark.sources.stream import landed_files
from tidemark.sources.tables import Tables
from tidemark.streaming.ingest import Ingest, stored_tail

T0 = at(2026, 10, 4, 18)
GOOD = {
    "meta": {"id": "6f7a3b2e-1c4d-4e5f-8a9b-0c1d2e3f4a5b", "dt": "2026-10-04T18:00:00.123Z", "domain": "en.wikipedia.org"},
    "wiki": "enwiki",
    "type": "edit",
    "namespace": 0,
    "title": "Lisbon",
    "bot": False,
}


def event(**changes):
    merged = {**GOOD, **changes}
    return {k: v for k, v in merged.items() if v is not ...}


def meta(**changes):
    return event(meta={**GOOD["meta"], **changes})


CASES = [
    (event(), "kept"),
    (event(bot=...), "kept"),
    (event(namespace=-1), "kept"),
    (event(wiki="wikidatawiki"), "other_wiki"),
    (event(type="log"), "other_type"),
    (event(type="categorize"), "other_type"),
    (meta(domain="canary"), "canary"),
    (event(meta={"domain": "canary"}), "canary"),
    (event(meta={}, wiki="frwiki"), "other_wiki"),
    (event(wiki=None), "malformed"),
    (event(wiki=...), "malformed"),
    (event(wiki=["enwiki"]), "malformed"),
    (event(type=["edit"]), "malformed"),
    (event(type=None), "malformed"),
    (event(meta="not a dict"), "malformed"),
    (event(meta=None), "malformed"),
    (event(title=""), "malformed"),
    (event(title=None), "malformed"),
    (event(title=7), "malformed"),
    (event(title="x" * 2_000), "malformed"),
    (event(title="ü" * 512), "kept"),
    (event(title="ü" * 513), "malformed"),
    (event(namespace="zero"), "malformed"),
    (event(namespace=True), "malformed"),
    (event(namespace=0.5), "malformed"),
    (event(namespace=0.0), "malformed"),
    (event(namespace=2**31), "malformed"),
    (event(namespace=-(2**31) - 1), "malformed"),
    (event(namespace=-(2**31)), "kept"),
    (event(namespace=10**30), "malformed"),
    (event(bot="false"), "malformed"),
    (event(bot=1), "malformed"),
    (event(bot=None), "malformed"),
    (meta(id=123), "malformed"),
    (meta(id="nope"), "malformed"),
    (meta(id="{6F7A3B2E1C4D4E5F8A9B0C1D2E3F4A5B}"), "kept"),
    (meta(dt=1), "malformed"),
    (meta(dt="2026-10-04T18:00:00"), "malformed"),
    (meta(dt="abcd"), "malformed"),
    (meta(dt="2026-02-30T18:00:00Z"), "malformed"),
    (meta(dt="2026-10-04T19:00:00.5+01:00"), "kept"),
    (meta(dt="20261004T180000Z"), "kept"),
    (meta(dt="1970-06-01T00:00:00Z"), "malformed"),
    (meta(dt="1971-01-01T00:00:00Z"), "kept"),
    (meta(dt="2106-01-01T00:00:00Z"), "malformed"),
    (meta(dt="2026-10-04T18:10:00Z"), "future"),
    (meta(dt="2026-10-04T18:05:00Z"), "kept"),
    (meta(dt="2026-10-01T00:00:00Z"), "kept"),
    *[(raw, "malformed") for raw in (None, [], [1, 2], 42, "text", True, {"meta": None})],
]


def landed(spark, items):
    """`(position, data, sse_id)` as landed messages received at T0."""
    return spark.createDataFrame([(p, s, d, T0) for p, d, s in items], LANDED)


def test_every_message_gets_one_outcome(spark):
    items = [(i, json.dumps(body), "[]") for i, (body, _) in enumerate(CASES)]
    items += [(900, "{nope", "[]"), (901, json.dumps(event()), ""), (902, "", "[]"), (903, '{"wiki":1,' + json.dumps(event())[1:], "[]")]
    got = {r["position"]: r["outcome"] for r in classify(landed(spark, items)).collect()}
    assert {i: got[i] for i in range(len(CASES))} == {i: want for i, (_, want) in enumerate(CASES)}
    assert got[900] == "malformed" and got[901] == "malformed"
    assert 902 not in got  # a keep-alive
    assert got[903] == "kept"  # of duplicate keys the last counts


def test_kept_rows_are_normalised(spark):
    body = meta(id="{6F7A3B2E1C4D4E5F8A9B0C1D2E3F4A5B}", dt="2026-10-04T19:00:00.1239+01:00")
    row = classify(landed(spark, [(1, json.dumps(body), "[]")])).first()
    assert row["event_id"] == GOOD["meta"]["id"]
    assert row["event_time"] == (T0 + timedelta(milliseconds=123)).replace(tzinfo=None)
    assert (row["lang"], row["namespace"], row["is_bot"]) == ("en", 0, False)


def test_floor_drops_older_events(spark):
    items = [(1, json.dumps(meta(dt="2026-10-04T17:59:59.999Z")), "[]"), (2, json.dumps(meta(dt="2026-10-04T18:00:00Z")), "[]")]
    got = classify(landed(spark, items), floor_ms=ms(T0)).orderBy("position").collect()
    assert [r["outcome"] for r in got] == ["before_floor", "kept"]


def test_batch_tokens_tell_events_of_one_millisecond_apart(spark):
    import hashlib

    same = [edit(T0, seq=1, event_id="a"), edit(T0, seq=2, event_id="b"), edit(T0 + timedelta(days=1), seq=3, event_id="c")]
    got = {str(r["day"]): r["token"] for r in seam.batch_tokens(frame(spark, same), 5_000).collect()}
    assert got["2026-10-04"] == hashlib.sha256(b"a\nb").hexdigest()[:32]
    assert got["2026-10-05"] == hashlib.sha256(b"c").hexdigest()[:32]


def test_first_arrival_wins_and_known_ids_are_dropped(spark):
    kept = spark.createDataFrame([(5, "a", "late"), (1, "a", "first"), (2, "b", "x"), (3, "c", "y")], "position BIGINT, event_id STRING, title STRING")
    tail = spark.createDataFrame([("c",)], "event_id STRING")
    got = seam.unseen(seam.first_arrivals(kept), tail).orderBy("position").collect()
    assert [(r["event_id"], r["title"]) for r in got] == [("a", "first"), ("b", "x")]
    plan = seam.first_arrivals(kept)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan  # limited before the shuffle too


def test_the_tail_is_the_last_rows_even_across_a_clock_jump(spark):
    hour_ns = 3_600 * 10**9
    base = 10 * hour_ns
    before = [edit(T0, seq=base + i, event_id=f"b{i}") for i in range(30)]
    after = [edit(T0, seq=base + 5 * hour_ns + i, event_id=f"a{i}") for i in range(5)]
    got = [r["event_id"] for r in stored_tail(frame(spark, before + after), 20).orderBy(F.desc("ingest_seq")).collect()]
    assert len(got) == 20 and got[:5] == [f"a{i}" for i in (4, 3, 2, 1, 0)]
    assert stored_tail(frame(spark, []), 20).count() == 0


def messages(spark, first, last, start=T0 - timedelta(days=1), step_s=600):
    """Messages `first..last-1`; every seventh repeats the one 5 before it."""
    items = []
    for i in range(first, last):
        n = i - 5 if i % 7 == 0 and i >= 5 else i
        when = start + timedelta(seconds=n * step_s % 86_000)
        body = {**event(title=f"Article {n % 4}", bot=n % 3 == 0), "meta": {"id": f"00000000-0000-4000-8000-{n:012d}", "dt": when.isoformat(), "domain": "x"}}
        items.append((i, json.dumps(body), f'[{{"timestamp":{i}}}]'))
    items.append((last * 1000, "{broken", "[]"))
    return landed(spark, items)


def truth(n):
    return {f"00000000-0000-4000-8000-{i - 5 if i % 7 == 0 and i >= 5 else i:012d}" for i in range(n)}


def ids(tables):
    return [r["event_id"] for r in tables.read("edits").select("event_id").collect()]


def assert_derived_match_raw(tables):
    edits = tables.read("edits")
    want = {tuple(r) for r in rollups.per_minute(edits).collect()}
    assert {tuple(r) for r in rollups.merge_counts(tables.read("edits_per_minute")).select("minute", "lang", "edits", "bot_edits").collect()} == want
    pages = {tuple(r) for r in rollups.pages_per_minute(edits).collect()}
    assert {tuple(r) for r in rollups.merge_pages(tables.read("pages_per_minute")).collect()} == pages


def test_the_stream_stores_every_event_once(spark, tables, tmp_path):
    land, check = str(tmp_path / "landed"), str(tmp_path / "checkpoint")
    ingest = Ingest(tables)
    for first, last in ((0, 60), (60, 130), (130, 200)):
        messages(spark, first, last).coalesce(1).write.mode("append").parquet(land)
        query = ingest.start(landed_files(spark, land, max_files=1), check, available_now=True)
        query.awaitTermination()
        assert query.exception() is None
    got = ids(tables)
    assert len(got) == len(set(got)) and set(got) == truth(200)
    assert_derived_match_raw(tables)
    seqs = [r["ingest_seq"] for r in tables.read("edits").orderBy(F.expr("CAST(regexp_extract(sse_id, '([0-9]+)') AS BIGINT)")).collect()]
    assert seqs == sorted(seqs) and len(set(seqs)) == len(seqs)  # increasing with arrival
    totals = {r["outcome"]: r["n"] for r in tables.read("outcomes").groupBy("outcome").agg(F.sum("n").alias("n")).collect()}
    assert totals["kept"] == len(got) and totals["malformed"] == 3
    assert totals["kept"] + totals["duplicate"] == 200

    # a new checkpoint over the same files finds everything stored already
    again = Ingest(tables).start(landed_files(spark, land), str(tmp_path / "checkpoint2"), available_now=True)
    again.awaitTermination()
    assert sorted(ids(tables)) == sorted(got)
    assert_derived_match_raw(tables)


def test_a_replayed_batch_changes_nothing(spark, tables):
    ingest = Ingest(tables)
    first, second = messages(spark, 0, 60), messages(spark, 60, 120)
    ingest.write(first, "run", 0)
    ingest.write(second, "run", 1)
    stored = sorted((r["event_id"], r["ingest_seq"]) for r in tables.read("edits").collect())
    ingest.write(second, "run", 1)  # as after a crash before the checkpoint commit
    Ingest(tables).write(first, "other", 0)
    assert sorted((r["event_id"], r["ingest_seq"]) for r in tables.read("edits").collect()) == stored
    assert {e for e, _ in stored} == truth(120)
    assert_derived_match_raw(tables)


def test_an_interrupted_batch_is_completed_by_its_replay(spark, tables, monkeypatch):
    ingest = Ingest(tables)
    real = Tables.write_once

    def fails(self, name, rows_, token):
        if name == "edits_per_minute":
            raise RuntimeError("executor lost")
        return real(self, name, rows_, token)

    monkeypatch.setattr(Tables, "write_once", fails)
    with pytest.raises(RuntimeError):
        ingest.write(messages(spark, 0, 60), "run", 0)
    monkeypatch.setattr(Tables, "write_once", real)
    assert tables.read("edits_per_minute").count() == 0 and len(ids(tables)) > 0  # raw only
    ingest.write(messages(spark, 0, 60), "run", 0)
    assert sorted(ids(tables)) == sorted(truth(60))
    assert_derived_match_raw(tables)


def test_a_retried_write_is_stored_once(tables):
    batch = rows(50, T0)
    store(tables, batch, "batch-1")
    store(tables, batch, "batch-1")
    assert tables.read("edits").count() == 50
    assert tables.read("edits_per_minute").agg(F.sum("edits")).first()[0] == 50


def test_a_batch_with_nothing_to_keep(spark, tables):
    ingest = Ingest(tables)
    ingest.write(landed(spark, [(1, "{broken", "[]"), (2, json.dumps(event(wiki="frwiki")), "[]")]), "run", 0)
    ingest.write(landed(spark, []), "run", 1)
    ingest.write(landed(spark, [(3, json.dumps(event()), "[]"), (4, json.dumps(event()), "[]")]), "run", 2)
    assert ids(tables) == [GOOD["meta"]["id"]]
    got = {r["outcome"]: r["n"] for r in tables.read("outcomes").groupBy("outcome").agg(F.sum("n").alias("n")).collect()}
    assert got == {"malformed": 1, "other_wiki": 1, "kept": 1, "duplicate": 1}


def test_one_id_in_a_third_of_the_batch_is_stored_once(spark, tables):
    """A hot id repeated thousands of times beside others, in many tasks."""
    rest = spark.range(4_000).selectExpr("id AS position", "format_string('00000000-0000-4000-8000-%012d', id) AS uid")
    hot = spark.range(2_000).selectExpr("10000 + id AS position", "'00000000-0000-4000-8000-999999999999' AS uid")
    body = (
        "concat('{\"meta\":{\"id\":\"', uid, '\",\"dt\":\"2026-10-04T18:00:00Z\",\"domain\":\"x\"},\"wiki\":\"enwiki\","
        "\"type\":\"edit\",\"namespace\":0,\"title\":\"Hot\"}')"
    )
    batch = rest.unionAll(hot).repartition(8).selectExpr(
        "position", "'[]' AS sse_id", f"{body} AS data", "timestamp'2026-10-04 18:00:01' AS received_at"
    )
    Ingest(tables).write(batch, "run", 0)
    stored = tables.read("edits")
    assert stored.count() == stored.select("event_id").distinct().count() == 4_001
    assert rollups.merge_counts(tables.read("edits_per_minute")).first()["edits"] == 4_001
    assert rollups.merge_pages(tables.read("pages_per_minute")).count() == 1


def test_outcomes_count_on_a_stream_too(spark, tmp_path):
    from tidemark.operators.classify import count_outcomes

    land = str(tmp_path / "landed")
    messages(spark, 0, 30).write.parquet(land)
    query = (
        count_outcomes(classify(landed_files(spark, land)))
        .writeStream.outputMode("complete").format("memory").queryName("outcomes_seen")
        .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    got = {r["outcome"]: r["n"] for r in spark.table("outcomes_seen").collect()}
    assert got == {"kept": 30, "malformed": 1}


def test_messages_without_a_place_in_the_stream_are_refused(spark, tables):
    unplaced = spark.createDataFrame([(None, "[]", json.dumps(event()), T0)], LANDED)
    with pytest.raises(ValueError, match="position"):
        Ingest(tables).write(unplaced, "run", 0)
    assert ids(tables) == []


def test_a_repeat_is_known_after_any_number_of_events_and_a_restart(spark, tables):
    """More than 20,000 ids between an event and its repeat, within one run and over a new checkpoint."""
    body = (
        "concat('{\"meta\":{\"id\":\"', format_string('00000000-0000-4000-8000-%012d', id), '\",\"dt\":\"', "
        "date_format(timestamp_seconds(1791100000 + id), \"yyyy-MM-dd'T'HH:mm:ss'Z'\"), '\",\"domain\":\"x\"},\"wiki\":\"enwiki\","
        "\"type\":\"edit\",\"namespace\":0,\"title\":\"T', id % 9, '\"}')"
    )

    def sent(first, last, position):
        return spark.range(first, last).selectExpr(
            f"{position} + id AS position", "'[]' AS sse_id", f"{body} AS data", f"timestamp_seconds(1791100002 + {last}) AS received_at"
        )

    ingest = Ingest(tables)
    ingest.write(sent(0, 3_000, 0), "one", 0)
    ingest.write(sent(3_000, 30_000, 0), "one", 1)
    ingest.write(sent(0, 500, 100_000), "one", 2)
    Ingest(tables).write(sent(200, 40_000, 200_000), "two", 0)
    stored = tables.read("edits")
    assert stored.count() == stored.select("event_id").distinct().count() == 40_000
    assert_derived_match_raw(tables)
    totals = {r["outcome"]: r["n"] for r in tables.read("outcomes").groupBy("outcome").agg(F.sum("n").alias("n")).collect()}
    assert totals == {"kept": 40_000, "duplicate": 500 + 29_800}
    seqs = stored.agg(F.count_distinct("ingest_seq")).first()[0]
    assert seqs == 40_000


def test_only_writes_of_the_same_minutes_are_opened(spark, tables):
    ingest = Ingest(tables)
    first, later = (messages(spark, 0, 6, start=T0 - timedelta(hours=h)) for h in (10, 2))
    ingest.write(first, "run", 0)
    assert ingest._stored(classify(later).where("outcome = 'kept'"), "run-000000001") is None
    known = ingest._stored(classify(first).where("outcome = 'kept'"), "run-000000001")
    assert {r["event_id"] for r in known.collect()} == truth(6)
    assert ingest._stored(classify(first).where("outcome = 'kept'"), "run-000000000") is None  # its own rows don't count


def test_the_ledger_adds_up_after_every_kind_of_write(spark, tables):
    from tidemark.operators import hours, ledger
    from tidemark.plans import upkeep

    def agree():
        edits, kept = tables.read("edits"), tables.ledger()
        assert ledger.raw_span(kept).collect() == hours.raw_span(edits).collect()
        assert ledger.head(kept).collect() == hours.head(edits).collect()
        assert ledger.max_ingest_seq(kept).collect() == hours.max_ingest_seq(edits).collect()
        assert ledger.ingest_mark(kept).collect() == hours.ingest_mark(edits).collect()
        assert ledger.latest_bookmark(kept).collect() == seam.latest_bookmark(edits).collect()
        assert tables.watermark_ms() == hours.raw_span(edits).first()["newest_ms"]
        assert tables.oldest_ms() == hours.raw_span(edits).first()["oldest_ms"]

    agree()
    for k in range(4):
        store(tables, rows(40, T0 + timedelta(hours=7 * k), first_seq=1 + 40 * k), f"run-{k:09d}")
        agree()
    day = tables.partitions("edits")[0]
    upkeep.compact(tables, "edits", day, ms(T0))
    agree()
    upkeep.delete_rows(tables, "edits", day, F.col("title") == "Article 1", ms(T0) + 9 * 86_400_000)
    agree()
    tables.drop_partition("edits", day)
    agree()
    tables.files.remove(tables.path("edit_batches"))
    assert tables.complete_ledger() > 0 and tables.complete_ledger() == 0
    agree()
    late = tables.stored_since(ms(T0 + timedelta(hours=21)))
    assert late.count() == 40 and set(r["token"] for r in late.select("token").collect()) == {"run-000000003"}


def test_larger_inputs_land_in_more_files(spark, tmp_path, monkeypatch):
    """One file is read by one task: a landing's files grow with its messages, and hold the same messages."""
    from tidemark.checks import stored_queries
    from tidemark.sources import given_tables as given

    monkeypatch.setattr(stored_queries, "MESSAGES_PER_FILE", 20)
    sf, landed = str(tmp_path / "sf"), str(tmp_path / "landed")
    spark.range(600).selectExpr(
        "id AS event_id", "timestamp_seconds(1700000000 + id) AS ts", "id AS user_id", "'view' AS event_type", "1.0D AS value", "concat('{\"k\": ', id, '}') AS props"
    ).write.parquet(f"{sf}/events.parquet")
    files = stored_queries._land(spark, sf, landed)
    written = spark.read.parquet(landed)
    assert files == 11 and len(written.inputFiles()) > stored_queries.LANDINGS * stored_queries.FILES_PER_LANDING
    assert sorted(map(tuple, written.collect())) == sorted(map(tuple, given.messages(spark, sf).collect()))
