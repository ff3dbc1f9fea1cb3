"""Text forms: article addresses, wiki languages, archive paths, batch tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Formats shared with readers of the data.
ARTICLE_HOST = ".wikipedia.org/wiki/"
HOUR_PATH = r"dt=(\d{4}-\d{2}-\d{2})/hour=([01]\d|2[0-3])(?:\.parquet|/[^/]+\.parquet)$"


def lang_of(wiki: Column | str) -> Column:
    """`enwiki` -> `en`."""
    return F.regexp_replace(wiki, "wiki$", "")


def article_url(lang: Column | str, title: Column | str) -> Column:
    """The article's address; every byte outside the RFC 3986 unreserved set is percent-encoded.

    `url_encode` is the form encoding, which leaves `*` alone and encodes `~`: both are put right.
    """
    encoded = F.url_encode(F.replace(title, F.lit(" "), F.lit("_")))
    encoded = F.replace(F.replace(encoded, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    return F.concat(F.lit("https://"), lang, F.lit(ARTICLE_HOST), encoded)


def hour_path(hour: Column | str) -> Column:
    """Where an hour lives under the archive root: `dt=2024-01-05/hour=09`."""
    return F.date_format(hour, "'dt='yyyy-MM-dd'/hour='HH")


def hour_of_path(path: Column | str) -> Column:
    """The hour a Parquet path belongs to, or NULL for anything that isn't one (or no real date)."""
    day, hh = F.regexp_extract(path, HOUR_PATH, 1), F.regexp_extract(path, HOUR_PATH, 2)
    return F.when(
        day != "", F.try_to_timestamp(F.concat_ws(" ", day, hh), F.lit("yyyy-MM-dd HH"))
    )


def batch_token(ids_in_order: Column) -> Column:
    """32 hex digits naming a batch by its event ids, in ingest order."""
    return F.left(F.sha2(F.concat_ws("\n", ids_in_order), 256), F.lit(32))
