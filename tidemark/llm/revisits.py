"""WARC not-modified revisits: an as-of join to the latest earlier full response of the same canonical URL.

A revisit record says that a page had not changed, and names it by validators only. It is resolved to the latest
full response of its canonical URL that was captured before it; the validators must agree, and the headers a 304
may update replace those of the response.

The as-of join is two windows: within (URL, time bucket) over records, and over one summary a bucket within a URL for what
lies before. So a URL with a third of all captures is spread over its buckets. Payloads never move; digests stand
for them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

BUCKET_S = 3_600

# The headers that a 304 response sends for the stored one (RFC 9110, 15.4.5).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")


def canonical_url(url: str | Column) -> Column:
    """Without scheme, fragment and default port, host in lower case, parameters in order; null without a host."""
    url = F.col(url) if isinstance(url, str) else url
    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^#]*)", 1)
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1)), ":(80|443)$", "")
    path = F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1)
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    ordered = F.array_join(F.array_sort(F.split(query, "&")), "&")
    full = F.concat(host, F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), ordered)))
    return F.when(host != "", full)


def page_captures(pages: DataFrame) -> DataFrame:
    """A capture log derived from the pages table: each page as a full response and, ten hours on, as a revisit."""
    sha = F.sha2("html", 256)
    seconds = F.col("page_id") * 60
    common = [F.col("url"), F.concat(F.lit('"'), F.left(sha, F.lit(16)), F.lit('"')).alias("etag"), seconds.cast("string").alias("last_modified")]

    def headers(**given: Column) -> Column:
        pairs = [x for k, v in given.items() for x in (F.lit(k.replace("_", "-")), v.cast("string"))]
        return F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull()).alias("headers")

    later = seconds + 600 * 60
    full = pages.select(
        (F.col("page_id") * 2).alias("record_id"), seconds.alias("time"), F.lit(False).alias("revisit"), *common, sha.alias("digest"),
        headers(cache_control=F.lit("max-age=60"), content_length=F.octet_length("html"), content_type=F.lit("text/html"), date=seconds, etag=common[1]),
    )
    again = pages.select(
        (F.col("page_id") * 2 + 1).alias("record_id"), later.alias("time"), F.lit(True).alias("revisit"), *common, F.lit(None).cast("string").alias("digest"),
        headers(cache_control=F.lit("max-age=120"), content_length=F.lit(0), date=later, etag=common[1], x_cache=F.lit("revalidated")),
    )
    return full.unionByName(again)


def resolve_revisits(records: DataFrame, bucket_s: int = BUCKET_S) -> DataFrame:
    """(record_id, url, source_id, outcome, digest, headers) for every revisit record.

    records has record_id, url, time (seconds), revisit, etag, last_modified, digest and headers (a map with names in
    lower case); other columns are ignored. outcome is resolved, mismatch (the validators differ: entity tags where both
    have one, else dates of modification), no_earlier, or no_url; digest and headers are set where it is resolved.
    Records of one time are ordered by record_id, so a response with the same time and a smaller id is earlier.
    A null time is before all others. Repeated revisit records are resolved each.
    """
    held = F.struct("record_id", "etag", "last_modified", "digest", "headers")
    log = records.select(
        "record_id", canonical_url("url").alias("url"), "time", "revisit", "etag", "last_modified", "digest", "headers",
        F.floor(F.coalesce("time", F.lit(-1)) / bucket_s).alias("bucket"),
    ).withColumn("full", F.when(~F.col("revisit"), held))
    place = F.struct(F.coalesce("time", F.lit(-1)), "record_id")
    inside = Window.partitionBy("url", "bucket").orderBy("time", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    near = log.where("url is not null").withColumn("near", F.last("full", ignorenulls=True).over(inside))
    ends = log.where("url is not null").groupBy("url", "bucket").agg(F.max_by("full", F.when(~F.col("revisit"), place)).alias("last"))
    along = Window.partitionBy("url").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = ends.withColumn("far", F.last("last", ignorenulls=True).over(along)).select("url", "bucket", "far")
    joined = near.where("revisit").join(before, ["url", "bucket"]).withColumn("found", F.coalesce("near", "far"))
    nowhere = log.where("revisit and url is null").withColumn("found", F.lit(None).cast(joined.schema["found"].dataType))
    asked = joined.select(*nowhere.columns).unionByName(nowhere)
    same = F.when(F.col("etag").isNotNull() & F.col("found.etag").isNotNull(), F.col("etag") == F.col("found.etag")).otherwise(
        F.coalesce(F.col("last_modified") == F.col("found.last_modified"), F.lit(False))
    )
    outcome = F.when(F.col("url").isNull(), "no_url").when(F.col("found").isNull(), "no_earlier").when(same, "resolved").otherwise("mismatch")
    sent = F.map_filter(F.coalesce("headers", F.expr("cast(map() as map<string, string>)")), lambda k, v: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter("found.headers", lambda k, v: ~F.map_contains_key(F.col("sent"), k)), F.col("sent"))
    done = asked.withColumn("outcome", outcome).withColumn("sent", sent)
    return done.select(
        "record_id", "url", F.col("found.record_id").alias("source_id"), "outcome",
        F.when(F.col("outcome") == "resolved", F.col("found.digest")).alias("digest"),
        F.when(F.col("outcome") == "resolved", merged).alias("headers"),
    )


def header_text(headers: str = "headers") -> Column:
    """Headers as lines in order of their names."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
