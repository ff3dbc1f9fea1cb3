"""From raw documents to token ids: quality rules, exact and near duplicates, a mix of the sources, encoding.

Each stage is written as Parquet before the next one reads it, so a lost executor costs at most one stage's work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import exact_dedup, jaccard_join, mixing, piece_transducer, quality_rules
from tidemark.llm.common import table, written
from tidemark.llm.queries import piece_model, trusted_ids


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = quality_rules.quality_rules(docs, trusted_ids(spark, sf_dir))
    return judged.where("kept").select(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.near_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return piece_transducer.encode_texts(docs, piece_model())


STAGES = [
    ("quality_rules", keep_good),
    ("exact_dedup", drop_exact_copies),
    ("jaccard_join", drop_near_copies),
    ("mixing", mix_sources),
    ("piece_transducer", encode),
]

#: Hash draws of the mix and the encoding have no SQL. tests/llm compare each stage's operator with brute force, and run() only for
#: whole round trips.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
