"""The registered queries of the text operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import compression_classifier, exact_dedup, jaccard_join, license_scan, mixing, periodic_runs, piece_transducer, quality_rules, ranked_search, repeat_index, revisits, secret_scan, wrapper_extract
from tidemark.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(run):
    QUERIES[run.__name__] = run
    return run


def trusted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents labelled as good: the trusted target."""
    return table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")


@query
def op1_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality_rules.quality_rules(docs, trusted_ids(spark, sf_dir))
    return judged.select("doc_id", *quality_rules.MEASURES, "n_grams", F.round("score", 6).alias("score"), "kept")


@query
def op2_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    plan = mixing.mix_plan(docs)
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("draws")).alias("taken"))


@query
def op7_license_scan(spark, sf_dir):
    return license_scan.license_scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op8_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op9_compression_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = compression_classifier.train(*compression_classifier.labelled_sample(docs, table(spark, sf_dir, "labels")))
    scores = compression_classifier.quality_scores(docs, model)
    held_out = compression_classifier.fold("doc_id") == compression_classifier.HELD_OUT
    return scores.select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= compression_classifier.THRESHOLD).cast("int").alias("predicted")
    )


@query
def op10_secret_scan(spark, sf_dir):
    return secret_scan.digest(secret_scan.secret_scan(table(spark, sf_dir, "documents").select("doc_id", "text")))


TOKENIZERS = "/opt/tokenizers"  # the folder of public vocabulary files
PIECE_MODEL = "piece_bpe_32k.model"


def piece_model(folder: str = TOKENIZERS) -> bytes:
    with open(f"{folder}/{PIECE_MODEL}", "rb") as file:
        return file.read()


@query
def op3_piece_transducer(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return piece_transducer.encode_texts(docs, piece_model())


@query
def op5_jaccard_join(spark, sf_dir):
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op4_wrapper_extract(spark, sf_dir):
    found = wrapper_extract.main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op6_revisits(spark, sf_dir):
    captures = revisits.page_captures(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return revisits.resolve_revisits(captures).withColumn("headers", revisits.header_text())


@query
def op12_periodic_runs(spark, sf_dir):
    docs = periodic_runs.with_periods(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return periodic_runs.digest(periodic_runs.periodic_runs(docs))


@query
def op13_ranked_search(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ranked_search.ranked_search(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


@query
def op11_repeat_index(spark, sf_dir):
    return repeat_index.digest(repeat_index.repeated_spans(table(spark, sf_dir, "documents").select("doc_id", "text")))
