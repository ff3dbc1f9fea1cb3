"""Exact quantiles that return an element of the data, without one task seeing all of it.

Pass 1 counts values in buckets whose number is fixed (2,048 per power of two), so the running
total that locates each quantile's bucket is over a bounded table. Pass 2 counts only the values
of the located buckets. Any skew in the values is pre-aggregated in both passes.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# An order-preserving bucket number, about 108,000 per sign over all of BIGINT: values below 2^12
# are their own bucket, larger ones keep their twelve leading bits. Negative values mirror.
_MAGNITUDE = "if(value < 0, ~value, value)"
_SHIFT = f"greatest(0, length(bin({_MAGNITUDE})) - 12)"
_NUMBER = f"({_SHIFT} * 2048 + shiftright({_MAGNITUDE}, {_SHIFT}))"
BUCKET = f"if(value < 0, -1 - {_NUMBER}, {_NUMBER})"

# Both `coalesce`d frames are bounded: `coarse` by the number of buckets, `inside` by the distinct
# values of the buckets the quantiles fall in (each spans 1/2,048 of its values' magnitude).
_LOCATE = """
SELECT bucket, through - n AS before, events, want.name AS name, want.rank AS rank
FROM (SELECT bucket, n, through, events, explode({wanted}) AS want
      FROM (SELECT bucket, n, sum(n) OVER (ORDER BY bucket ROWS UNBOUNDED PRECEDING) AS through,
                   sum(n) OVER (ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS events
            FROM {{coarse}}))
WHERE want.rank >= through - n AND want.rank < through
"""
_PICK = """
SELECT coalesce(max(events), 0L) AS events, {picked}
FROM (SELECT *, before + sum(n) OVER (PARTITION BY name ORDER BY value ROWS UNBOUNDED PRECEDING) AS through FROM {{inside}})
WHERE rank < through
"""


def exact_quantiles(values: DataFrame, column: str, probabilities: Mapping[str, float]) -> DataFrame:
    """One row: `events` and each named quantile of `column` (BIGINT); quantiles are NULL if empty.

    A quantile p of n values is the element at 0-based rank floor(p * n) in sorted order.
    """
    spark = values.sparkSession
    rows = values.selectExpr(f"CAST({column} AS BIGINT) AS value").where("value IS NOT NULL")
    rows = rows.selectExpr("value", f"{BUCKET} AS bucket")
    ranks = ", ".join(
        f"named_struct('name', '{k}', 'rank', least(floor({float(p)}D * events), events - 1))" for k, p in probabilities.items()
    )
    coarse = rows.groupBy("bucket").agg(F.expr("count(*) AS n")).coalesce(1)
    located = spark.sql(_LOCATE.format(wanted=f"array({ranks})"), coarse=coarse)
    # At most one bucket per quantile is located: a handful of rows.
    inside = (
        rows.join(F.broadcast(located), "bucket")
        .groupBy("name", "value", "before", "rank", "events")
        .agg(F.expr("count(*) AS n"))
        .coalesce(1)
    )
    picked = ", ".join(f"min(value) FILTER (WHERE name = '{k}') AS {k}" for k in probabilities)
    return spark.sql(_PICK.format(picked=picked), inside=inside)
