"""Headline queries over stored tables filled from the given data; prints one JSON line.

BENCH_SF_DIR    input folder (default /root/testdata/sf0.1)
BENCH_CPUS      local cores (default 8)
BENCH_RUNS      timed runs per query after one warm-up (default 3, the median counts)
BENCH_DAYS      also time the window queries over this many generated days at 11 edits/s (default 0;
                7 days are 6,652,800 rows)
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from tidemark.config import LANGS, TOP_N, WINDOWS_S  # noqa: E402
from tidemark.operators import classify, costs, hours, lag, ledger, reconcile, rollups, series, slo, windows  # noqa: E402
from tidemark.plans import activity, ops_report, page_sets, snapshot  # noqa: E402
from tidemark.session import local_session  # noqa: E402
from tidemark.sources import generator, given_tables as given  # noqa: E402
from tidemark.sources.tables import Tables  # noqa: E402
from tidemark.streaming.ingest import Ingest, stored_tail  # noqa: E402

RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def timed(run) -> float:
    run()
    taken = []
    for _ in range(RUNS):
        started = time.perf_counter()
        run()
        taken.append(time.perf_counter() - started)
    return round(statistics.median(taken), 4)


def once(run) -> float:
    started = time.perf_counter()
    run()
    return round(time.perf_counter() - started, 4)


def store(tables: Tables, edits) -> None:
    tables.write_once("edits", edits.withColumn("dt", F.to_date("event_time")), "bench")
    stored = tables.read("edits")
    tables.write_once("edits_per_minute", rollups.with_month(rollups.per_minute(stored)), "bench")
    page_sets.add_pages(tables, stored, "bench")


def window_cases(tables: Tables) -> dict:
    edits, minutes, pages = tables.read("edits"), tables.read("edits_per_minute"), tables.page_sets()
    to_ms = tables.watermark_ms()
    now_ms = to_ms + 30_000

    def ask(window):
        return lambda: activity.activity(edits, minutes, pages, activity.parse_request("all", window, LANGS), now_ms, tables.watermark_ms()).collect()

    return {
        "newest": tables.watermark_ms,
        "window_totals_5m": lambda: windows.window_totals(edits, to_ms, 300, LANGS).collect(),
        "top_articles_5m": lambda: windows.top_articles(edits, to_ms, 300, TOP_N).collect(),
        "edits_per_minute": lambda: series.edits_per_minute_series(minutes, edits, to_ms, 60).collect(),
        "ingest_lag_last_minute": lambda: lag.ingest_lag(edits, to_ms).collect(),
        "activity_1h": ask("1h"),
        "activity_24h": ask("24h"),
        "activity_3d": ask("3d"),
        "activity_7d": ask("7d"),
        "activity_7d_raw": lambda: windows.window_totals(edits, to_ms, WINDOWS_S["7d"], LANGS).collect(),
        "ops_lag_last_hour": lambda: lag.stored_lag(tables.stored_since(now_ms - 3_600_000), now_ms).collect(),
        "ops_bookmark": lambda: ledger.latest_bookmark(tables.ledger()).collect(),
        "ops_head": lambda: ledger.head(tables.ledger()).collect(),
        "resume_max_seq": lambda: ledger.max_ingest_seq(tables.ledger()).collect(),
        "resume_last_20k": lambda: stored_tail(edits, 20_000).collect(),
    }


def store_logs(tables: Tables, spark, sf_dir: str) -> None:
    tables.write_once("ingest_gaps", given.gaps(spark, sf_dir), "bench")
    tables.write_once("ingest_reconnects", given.reconnects(spark, sf_dir), "bench")
    tables.write_once("freshness_samples", given.samples(spark, sf_dir), "bench")
    tables.write_once("aws_cost", costs.parse_answers(given.cost_answers(spark, sf_dir)), "bench")


def report_cases(tables: Tables) -> dict:
    edits, minutes = tables.read("edits"), tables.read("edits_per_minute")
    gaps, drops = tables.read("ingest_gaps"), tables.read("ingest_reconnects")
    samples, attempts = tables.read("freshness_samples"), tables.read("aws_cost")
    to_ms = tables.watermark_ms()
    now_ms, oldest_s = to_ms + 30_000, hours.raw_span(edits).first()["oldest_ms"] // 1000
    span = reconcile.settled_range(oldest_s, now_ms, 900)
    end_s = to_ms // 60_000 * 60
    return {
        "recent_gaps": lambda: series.recent_gaps(gaps, to_ms, 60).collect(),
        "ops_freshness_30d": lambda: slo.freshness(samples, 60.0, end_s - 30 * 86_400, end_s).collect(),
        "snapshot": lambda: snapshot.to_document(snapshot.snapshot(edits, minutes, gaps, now_ms, to_ms=tables.watermark_ms())).collect(),
        "ops_report": lambda: snapshot.to_document(ops_report.ops_report(tables.stored_since(now_ms - 3_600_000), drops, samples, gaps, attempts, now_ms, ledger=tables.ledger())).collect(),
        "reconcile": lambda: reconcile.mismatches(edits, minutes, *span).collect(),
        "hour_counts": lambda: hours.hour_counts(edits).collect(),
        "rollup_build": lambda: rollups.per_minute(edits).write.format("noop").mode("overwrite").save(),
        "pages_build": lambda: rollups.pages_per_minute(edits).write.format("noop").mode("overwrite").save(),
    }


def ingest_cases(spark, sf_dir: str, root: str) -> tuple[dict, int]:
    landed = f"{root}/landed"
    given.messages(spark, sf_dir).repartition(8).write.parquet(landed)
    messages = spark.read.parquet(landed)
    tables = Tables(spark, f"{root}/ingested")
    runs = iter(range(100))

    def ingest():
        Ingest(tables).write(messages, f"bench{next(runs)}", 0)

    ingest()
    return {
        "classify": timed(lambda: classify.classify(messages).write.format("noop").mode("overwrite").save()),
        "ingest_batch": once(ingest),
    }, messages.count()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    root = tempfile.mkdtemp(prefix="bench-")
    tables = Tables(spark, f"{root}/tables")
    built = once(lambda: store(tables, given.edits(spark, sf_dir)))
    store_logs(tables, spark, sf_dir)
    queries = {}
    for name, run in {**window_cases(tables), **report_cases(tables)}.items():
        queries[name] = timed(run)
    ingest, n_messages = ingest_cases(spark, sf_dir, root)
    queries |= ingest
    result = {
        "metric": "total_query_seconds",
        "value": round(sum(queries.values()), 3),
        "unit": "sec",
        "queries": queries,
        "store_build": built,
        "sf": os.path.basename(sf_dir.rstrip("/")),
        "messages_per_sec": {"classify": round(n_messages / ingest["classify"]), "ingest": round(n_messages / ingest["ingest_batch"])},
    }
    days = int(os.environ.get("BENCH_DAYS", "0"))
    if days:
        big = Tables(spark, f"{root}/generated")
        filled = once(lambda: store(big, generator.synthetic_edits(spark, days, 11, 1_791_500_000_000)))
        result["generated"] = {"days": days, "rows": days * 86_400 * 11, "store_build": filled}
        result["generated"] |= {name: timed(run) for name, run in window_cases(big).items()}
    print(json.dumps(result))


if __name__ == "__main__":
    main()
