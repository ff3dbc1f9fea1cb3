from __future__ import annotations

import os
import sys
from datetime import datetime, timedelta, timezone

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from tidemark.session import local_session  # noqa: E402
from tidemark.sources.tables import Tables  # noqa: E402

UTC = timezone.utc
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    work = str(tmp_path_factory.mktemp("shared"))
    session = local_session(**{"spark.checkpoint.dir": work, "spark.sql.shuffle.partitions": "4"})
    yield session


@pytest.fixture
def tables(spark, tmp_path):
    return Tables(spark, str(tmp_path / "store"))


def at(*args) -> datetime:
    return datetime(*args, tzinfo=UTC)


def ms(moment: datetime) -> int:
    return int(moment.timestamp() * 1000)


def edit(event_time, title="Article 0", lang="en", seq=1, bot=False, namespace=0, sse_id="[]", event_id=None, ingested_at=None):
    return {
        "event_id": event_id or f"00000000-0000-4000-8000-{seq:012d}",
        "event_time": event_time,
        "ingested_at": ingested_at or event_time + timedelta(seconds=1),
        "wiki": f"{lang}wiki",
        "lang": lang,
        "type": "edit",
        "namespace": namespace,
        "title": title,
        "is_bot": bot,
        "sse_id": sse_id,
        "ingest_seq": seq,
    }


def rows(n, start, lang="en", bot_every=0, first_seq=1):
    """One edit a second from `start`; titles cycle through three articles."""
    return [
        edit(
            start + timedelta(seconds=i),
            title=f"Article {i % 3}",
            lang=lang,
            seq=first_seq + i,
            bot=bool(bot_every) and i % bot_every == 0,
            sse_id=f'[{{"timestamp":{i}}}]',
        )
        for i in range(n)
    ]


EDIT_DDL = (
    "event_id STRING, event_time TIMESTAMP, ingested_at TIMESTAMP, wiki STRING, lang STRING, type STRING, "
    "namespace INT, title STRING, is_bot BOOLEAN, sse_id STRING, ingest_seq BIGINT"
)


def frame(spark, dicts):
    names = [c.split()[0] for c in EDIT_DDL.split(", ")]
    return spark.createDataFrame([tuple(d[k] for k in names) for d in dicts], EDIT_DDL)


def store(tables, dicts, token, derived=True):
    """Write edits as ingest does: raw rows, then counts and page sets from them."""
    from tidemark.operators import rollups

    edits = frame(tables.spark, dicts).withColumn("dt", F.to_date("event_time"))
    tables.write_once("edits", edits, token)
    if derived:
        written = tables.read_token("edits", token)
        tables.write_once("edits_per_minute", rollups.with_month(rollups.per_minute(written)), token)
        tables.write_once("pages_per_minute", rollups.with_day(rollups.pages_per_minute(written)), token)


def per_minute(tables):
    from tidemark.operators.rollups import merge_counts

    got = merge_counts(tables.read("edits_per_minute")).orderBy("minute", "lang").collect()
    return [(r["minute"], r["lang"], r["edits"], r["bot_edits"]) for r in got]
