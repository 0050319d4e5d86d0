"""Mergeable summaries per group and hour: quantiles and distinct counts over long periods without a rescan.

An hour's rows become one row: count, sum, maximum, a KLL sketch of the values and a HyperLogLog sketch of a
second column. Any period is answered from the hours' rows alone. The exact forms are in ``reports``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.functions.values import truncated

#: Size of a quantile sketch: ranks are within RANK_ERROR of the true ones (99 % confidence).
KLL_K = 400
RANK_ERROR = 0.0165
#: Log of the distinct sketch's registers: counts are within COUNT_ERROR (three standard errors).
HLL_LOG_K = 12
COUNT_ERROR = 0.05


def hourly(df: DataFrame, keys: Sequence[str], ts: str, value: str, distinct: str, k: int = KLL_K) -> DataFrame:
    """One row per ``keys`` and hour. ``value`` is a whole number; NULLs of it and of ``distinct`` do not count."""
    hour = truncated("hour", F.col(ts), df.schema[ts].dataType)
    return df.groupBy(*keys, hour.alias("hour")).agg(
        F.count(value).alias("n"),
        F.sum(value).alias("total"),
        F.max(value).alias("max"),
        F.kll_sketch_agg_bigint(F.col(value).cast("bigint"), k).alias("quantiles"),
        F.hll_sketch_agg(distinct, HLL_LOG_K).alias("members"),
    )


def summary(hours: DataFrame, keys: Sequence[str], percents: Sequence[int] = (50, 90, 95, 99)) -> DataFrame:
    """Count, mean, maximum, percentiles ``p<n>`` and distinct ``members`` of the given hours per ``keys``.

    ``keys`` may be fewer than those the hours were built with.
    """
    merged = hours.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        F.sum("total").alias("total"),
        F.max("max").alias("max"),
        F.kll_merge_agg_bigint("quantiles").alias("_quantiles"),
        F.hll_sketch_estimate(F.hll_union_agg("members")).alias("members"),
    )
    at = lambda p: F.when(F.col("n") > 0, F.kll_sketch_get_quantile_bigint("_quantiles", F.lit(p / 100.0)))
    return merged.select(
        *keys, "n", F.try_divide("total", "n").alias("mean"), "max", *[at(p).alias(f"p{p}") for p in percents], "members"
    )
