"""What the text operators share: given tables, words, name clashes, written intermediate tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.session import work_path

SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(text: str | Column) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words(text: str | Column) -> Column:
    return F.regexp_extract_all(whole(text), F.lit(WORD), F.lit(0))


def squeezed(text: str | Column) -> Column:
    """The text without white space."""
    return F.translate(whole(text), SPACE, "")


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Drop columns that a result is about to add, whatever their case."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write to the shared folder and read back, so that a lost executor costs a file read."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
