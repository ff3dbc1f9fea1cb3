"""Exact dedup by content sort.

Texts are equal when they are identical after all white space is deleted. The rows are range-partitioned
by their normalised bytes with sampled splitters, sorted there (spilling to disk where needed), so that
equal texts are neighbours, and each row is compared in full with the one before it: that is how the
window below finds where a run of equal texts ends. Of a run the row with the most code points stays,
then the one with the smallest identifier.

The splitters are drawn from a short key (first characters, hash, salt), never from whole texts, so what
the driver samples is bounded. The salt lets the splitters cut a run of many copies into pieces that
different tasks take; each piece is folded to one row, and only those meet on the digest (at most `salts`
rows of a text), whatever the size of the group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.llm.common import squeezed, whole, written

SALTS = 64
HEAD_CHARS = 32


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", salts: int = SALTS) -> DataFrame:
    """Each row with the digest of its text, its salt, and what its piece of the run holds."""
    rows = docs.select(
        F.col(doc_id).alias("id"),
        squeezed(text).alias("norm"),
        F.length(whole(text)).cast("long").alias("chars"),
    )
    keyed = rows.select(
        "*",
        F.substring("norm", 1, HEAD_CHARS).alias("head"),
        F.xxhash64("norm").alias("hash"),
        F.pmod(F.xxhash64("id", "chars"), F.lit(salts)).cast("int").alias("salt"),
    )
    placed = keyed.repartitionByRange("head", "hash", "salt")
    run = Window.partitionBy("head", "hash", "salt", "norm")
    ranked = run.orderBy(F.desc("chars"), F.asc_nulls_last("id"))
    return placed.select(
        "id",
        F.sha2("norm", 256).alias("sha"),
        "salt",
        F.row_number().over(ranked).alias("place"),
        F.first(F.struct("chars", "id")).over(ranked).alias("best"),
        F.count(F.lit(1)).over(run).alias("n"),
    )


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", salts: int = SALTS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row.

    A null text counts as empty, and all empty texts are one group. Repeated rows (same identifier and
    text) are members of their group like any other; exactly one row of a group is kept. A null
    identifier sorts after all others. An empty table gives an empty result; other columns are ignored.
    """
    found = written(pieces(docs, doc_id, text, salts), "exact-pieces")
    group = Window.partitionBy("sha")
    first = group.orderBy(F.desc("best.chars"), F.asc_nulls_last("best.id"), "salt")
    leads = found.where("place = 1").select(
        "sha",
        "salt",
        F.first("best").over(first).alias("keep"),
        F.row_number().over(first).alias("rank"),
        F.sum("n").over(group).alias("size"),
    )
    return found.join(leads, ["sha", "salt"]).select(
        F.col("id").alias("doc_id"),
        F.col("keep.id").alias("keep_id"),
        F.col("size").cast("long").alias("group_size"),
        ((F.col("place") == 1) & (F.col("rank") == 1)).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with their own columns, whatever their names.

    Null texts and identifiers, repeated rows and empty tables as in `exact_groups`: one row of each group stays.
    """
    stays = exact_groups(docs, doc_id, text).where("kept").select(_key("doc_id"), F.col("text_sha256").alias("sha"))
    whole_row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(whole_row, _key(doc_id), F.sha2(squeezed(text), 256).alias("sha"))
    given = F.col("row").getField(text)
    same = Window.partitionBy("key", "sha").orderBy(F.desc(F.length(whole(given))), given)
    return rows.join(stays, ["key", "sha"], "left_semi").withColumn("n", F.row_number().over(same)).where("n = 1").select("row.*")


def _key(doc_id: str):
    return F.coalesce(F.concat(F.lit("s"), F.col(doc_id).cast("string")), F.lit("n")).alias("key")
