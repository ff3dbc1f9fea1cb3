"""Monthly cost answers: landed JSON to attempts, attempts to this month's figure."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.times import at_ms, month_start, ms


def cost_period(day: Column) -> tuple[Column, Column]:
    """The month so far: its first day, to the day after `day` (exclusive)."""
    return month_start(day), F.date_add(day, 1)


def parse_answers(answers: DataFrame) -> DataFrame:
    """`fetched_at, response` (JSON text) -> one attempt row each.

    An answer that isn't exactly one month with an amount and a unit is a failed attempt.
    """
    body = answers.withColumn("v", F.try_parse_json("response"))
    months = F.try_variant_get("v", "$.ResultsByTime", "array<variant>")
    total = "$.ResultsByTime[0].Total.UnblendedCost"
    read = body.select(
        "fetched_at",
        F.coalesce(F.size(months), F.lit(0)).alias("months"),
        F.try_variant_get("v", f"{total}.Amount", "string").alias("amount"),
        F.try_variant_get("v", f"{total}.Unit", "string").alias("currency"),
        F.coalesce(F.try_variant_get("v", "$.ResultsByTime[0].Estimated", "boolean"), F.lit(False)).alias("estimated"),
    )
    ok = (F.col("months") == 1) & F.col("amount").isNotNull() & F.col("currency").isNotNull()
    start, end = cost_period(F.to_date("fetched_at"))
    wrong = F.concat(F.lit("expected one month of results, got "), F.greatest("months", F.lit(0)))
    error = F.when(ok, "").when(F.col("months") == 1, "amount or unit missing").otherwise(wrong)
    return read.select(
        "fetched_at",
        ok.alias("ok"),
        start.alias("period_start"),
        end.alias("period_end"),
        F.when(ok, F.col("amount")).otherwise("").alias("amount"),
        F.when(ok, F.col("currency")).otherwise("").alias("currency"),
        (ok & F.col("estimated")).alias("estimated"),
        error.alias("error"),
    )


def cost_figure(costs: DataFrame, month: date) -> DataFrame:
    """One row: the latest attempt, and this month's latest good figure, from one read."""
    good = F.col("ok") & (F.col("period_start") == F.lit(month))
    at_good = F.when(good, F.col("fetched_at"))

    def latest(column: str) -> Column:
        return F.max_by(column, at_good).alias(f"fig_{column}")

    return costs.agg(
        F.count(F.lit(1)).alias("attempts"),
        ms(F.max("fetched_at")).alias("fetched_ms"),
        F.max_by("ok", "fetched_at").alias("last_ok"),
        F.count_if(good).alias("figures"),
        ms(F.max(at_good)).alias("figure_ms"),
        latest("period_start"),
        latest("period_end"),
        latest("amount"),
        latest("currency"),
        latest("estimated"),
    )


def recorded_on(costs: DataFrame, now_ms: int) -> DataFrame:
    """Attempts on record for the UTC day of `now`."""
    return costs.where(F.to_date("fetched_at") == F.to_date(at_ms(now_ms))).agg(F.count(F.lit(1)).alias("n"))
