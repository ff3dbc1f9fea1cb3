"""Stored files keep the order that row groups are pruned by."""

from __future__ import annotations

import glob

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from conftest import at, frame, rows


def test_written_files_are_sorted(tables):
    edits = rows(200, at(2026, 10, 1, 23, 58), lang="pt") + rows(200, at(2026, 10, 1, 23, 57), lang="en", first_seq=500)
    tables.write_once("edits", frame(tables.spark, edits).repartition(5).withColumn("dt", F.to_date("event_time")), "order")
    files = glob.glob(f"{tables.root}/edits/**/*.parquet", recursive=True)
    assert files
    for file in files:
        got = pq.ParquetFile(file).read(columns=["lang", "event_time"]).to_pylist()
        keys = [(r["lang"], r["event_time"]) for r in got]
        assert keys == sorted(keys)
