"""The live snapshot: one document of the last five minutes and the last hour's chart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import DEFAULTS, SNAPSHOT_MINUTES, SNAPSHOT_WINDOW_S, TOP_N, Settings
from tidemark.functions.ratios import share
from tidemark.functions.status import snapshot_status
from tidemark.functions.text import article_url
from tidemark.functions.times import at_ms, iso
from tidemark.operators.lag import ingest_lag
from tidemark.operators.series import minute_parts, minute_series
from tidemark.operators.windows import newest_ms, top_articles, window_totals

DATASET = "wikipedia"
JSON = {"ignoreNullFields": "false"}


# What each section adds to the fold; a section leaves the others' columns NULL.
_SECTIONS = {
    "edits": "BIGINT",
    "pages": "BIGINT",
    "bot_edits": "BIGINT",
    "article": "STRUCT<less: BIGINT, title: STRING, place: INT, lang: STRING, edits: BIGINT>",
    "bucket": "STRUCT<t: BIGINT, edits: BIGINT, partial: BOOLEAN>",
}


def _section(rows: DataFrame, **columns: str) -> DataFrame:
    """`lang` and one section's columns, in the fold's layout."""
    return rows.selectExpr("lang", *[f"CAST({columns.get(c, 'NULL')} AS {kind}) AS {c}" for c, kind in _SECTIONS.items()])


def _for_all(rows: DataFrame) -> DataFrame:
    """Each row once for its language and once for `all`."""
    return rows.selectExpr("*", "explode(array(lang, 'all')) AS for_lang").selectExpr("for_lang AS lang", "* EXCEPT (lang, for_lang)")


def snapshot_langs(
    edits: DataFrame, per_minute: DataFrame, gaps: DataFrame | None, to_ms: int, settings: Settings = DEFAULTS
) -> DataFrame:
    """One row per language and for `all`: totals, top articles, 60 minute buckets.

    The sections are stacked and folded by language in one small shuffle: at most two rows a
    language of totals, `TOP_N` articles a language for each of two lists, and 60 buckets a list.
    No joins, and a language with nothing counted is still listed.
    """
    langs = settings.langs
    places = ", ".join(f"'{x}'" for x in [*langs, "all"])
    totals = _section(
        _for_all(window_totals(edits, to_ms, SNAPSHOT_WINDOW_S, langs)), edits="edits", pages="pages", bot_edits="bot_edits"
    )
    tops = top_articles(edits, to_ms, SNAPSHOT_WINDOW_S, TOP_N).where(F.col("lang").isin(*langs))
    tops = tops.selectExpr(
        "lang",
        f"named_struct('less', -edits, 'title', title, 'place', CAST(array_position(array({places}), lang) AS INT), "
        "'lang', lang, 'edits', edits) AS article",
    )
    parts = minute_parts(per_minute, edits, to_ms, SNAPSHOT_MINUTES)
    chart = minute_series(parts, gaps, to_ms, SNAPSHOT_MINUTES, langs)
    spine = edits.sparkSession.range(0, 1, 1, 1).selectExpr(f"explode(array({places})) AS lang")
    stacked = (
        _section(spine)
        .unionAll(totals)
        .unionAll(_section(_for_all(tops), article="article"))
        .unionAll(_section(chart, bucket="named_struct('t', t, 'edits', edits, 'partial', partial)"))
    )
    folded = stacked.groupBy("lang").agg(
        F.expr("coalesce(sum(edits), 0L) AS edits_5m"),
        F.expr("coalesce(sum(pages), 0L) AS pages_5m"),
        share(F.sum("bot_edits"), F.sum("edits")).alias("bot_share_5m"),
        F.expr(f"slice(array_sort(collect_list(article)), 1, {TOP_N}) AS ordered"),
        F.expr("array_sort(collect_list(bucket)) AS per_minute"),
    )
    articles = F.transform(
        "ordered",
        lambda a: F.struct(
            a["title"].alias("title"),
            a["lang"].alias("lang"),
            a["edits"].alias("edits"),
            article_url(a["lang"], a["title"]).alias("url"),
        ),
    )
    return folded.select("lang", "edits_5m", "pages_5m", "bot_share_5m", articles.alias("top_articles"), "per_minute")


def _head(to_ms: int | None, now_ms: int, settings: Settings) -> list[Column]:
    """What the snapshot says about itself, before its contents."""
    newest = F.lit(to_ms).cast("bigint")
    return [
        F.lit(DATASET).alias("dataset"),
        snapshot_status(newest, now_ms, settings.stale_after_s).alias("status"),
        iso(at_ms(now_ms)).alias("computed_at"),
        iso(F.timestamp_millis(newest)).alias("as_of"),
        F.when(newest.isNotNull(), F.greatest(F.lit(0), F.lit(now_ms) - newest) / 1000).alias("last_event_age_s"),
        F.lit(float(settings.stale_after_s)).alias("stale_after_s"),
    ]


def snapshot(
    edits: DataFrame,
    per_minute: DataFrame,
    gaps: DataFrame | None,
    now_ms: int,
    settings: Settings = DEFAULTS,
    to_ms: int | None = None,
) -> DataFrame:
    """One row with the whole document; `langs` maps each language and `all` to its summary.

    `to_ms` is the watermark every part ends at; pass `Tables.watermark_ms()` to read it from the
    newest day alone, else it is read from `edits`. The lag and the languages are scalar subqueries, which Spark runs side by side.
    """
    one = edits.sparkSession.range(0, 1, 1, 1)
    to_ms = newest_ms(edits) if to_ms is None else to_ms
    head = _head(to_ms, now_ms, settings)
    if to_ms is None:
        return one.select(*head, F.create_map().alias("langs"))
    places = ", ".join(f"'{x}'" for x in [*settings.langs, "all"])
    entry = (
        f"named_struct('i', array_position(array({places}), lang), 'lang', lang, 's', "
        "struct(edits_5m, pages_5m, bot_share_5m, top_articles, per_minute))"
    )
    langs = snapshot_langs(edits, per_minute, gaps, to_ms, settings).agg(
        F.expr(f"map_from_entries(transform(array_sort(collect_list({entry})), x -> struct(x.lang, x.s))) AS langs")
    )
    lag = ingest_lag(edits, to_ms).selectExpr("struct(p50_ms AS p50, p95_ms AS p95) AS lag")
    return one.select(
        *head,
        lag.scalar().alias("ingest_lag_ms"),
        F.lit(SNAPSHOT_WINDOW_S).alias("window_s"),
        langs.scalar().alias("langs"),
    )


def to_document(one_row: DataFrame, status: str | None = None) -> DataFrame:
    """A report row as compact JSON; `status` marks a copy (`fallback`)."""
    if status is not None:
        one_row = one_row.withColumn("status", F.lit(status))
    return one_row.select(F.to_json(F.struct("*"), JSON).alias("body"))
