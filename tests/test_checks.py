"""Every registered query against its SQL, and the generated data's shape."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from conftest import SF
from tidemark.checks.compare import compare
from tidemark.checks.oracle import SQL
from tidemark.checks.queries import QUERIES
from tidemark.sources import generator


def test_every_query_has_its_check():
    # text operators that SQL can't express are held against brute force in their own tests
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


def test_the_flagship_query_runs(spark):
    rows = entry.entry(spark).collect()
    assert {r["lang"] for r in rows} == {"en", "pt", "de", "all"}


def test_queries_agree_with_sql(spark):
    results = compare(spark, SF, QUERIES)  # text operators' queries are compared in their own tests
    assert {n: r for n, r in results.items() if not r.startswith("ok")} == {}


def test_adapters_agree(spark):
    from tidemark.checks import inputs_sql as inp
    from tidemark.sources import given_tables as given

    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    sql = inp.with_inputs(inp.BASE, inp.EDITS) + "SELECT event_id, epoch_ms(event_time), epoch_ms(ingested_at), wiki, lang, type, namespace, title, is_bot, sse_id, ingest_seq FROM edits"
    got = given.edits(spark, SF).withColumns({"event_time": F.unix_millis("event_time"), "ingested_at": F.unix_millis("ingested_at")})
    assert sorted(tuple(r) for r in got.collect()) == sorted(con.execute(sql).fetchall())


def test_synthetic_edits(spark):
    end = 1_791_500_000_000
    edits = generator.synthetic_edits(spark, 1, 2, end)
    row = edits.agg(
        F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"), F.min(F.unix_millis("event_time")).alias("lo"),
        F.max(F.unix_millis("event_time")).alias("hi"), F.avg(F.col("is_bot").cast("int")).alias("bots"),
        F.avg((F.col("lang") == "en").cast("int")).alias("en"), F.avg((F.col("type") == "new").cast("int")).alias("new"),
        F.count_distinct("ingest_seq").alias("seqs"),
    ).first()
    assert row["n"] == row["ids"] == row["seqs"] == 172_800
    assert (row["lo"], row["hi"]) == (end - 86_400_000, end - 500)
    assert row["bots"] == pytest.approx(0.2, abs=0.01) and row["en"] == pytest.approx(0.65, abs=0.01) and row["new"] == pytest.approx(0.1, abs=0.01)
    samples = generator.synthetic_samples(spark, 5_000, end)
    assert samples.where("age_s > 60").count() == 10 and samples.select("minute").distinct().count() == 5_000
