"""First row per group, top-k and exact order statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_group(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column]) -> DataFrame:
    """Keep the first row of every group.

    Spark cuts each group to one row on the map side before the shuffle
    (WindowGroupLimit), so a key that holds most of the rows still sends at
    most one row per map task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def top(df: DataFrame, order: Sequence[Column], k: int | None) -> DataFrame:
    """Ordered rows, the first ``k`` if given (one heap per task, no full sort)."""
    ordered = df.orderBy(*order)
    return ordered if k is None else ordered.limit(k)


def exact_percentiles(
    df: DataFrame, group: Sequence[str], value: str, percents: Sequence[int], coarse: int = 1024
) -> DataFrame:
    """Nearest-rank percentiles of a whole-number column, one column ``p<n>`` each.

    Values are counted first, then located in two steps: running totals over
    ranges of ``coarse`` neighbouring values find the range that holds the
    wanted rank, and running totals inside that range find the value. No task
    sees more than the distinct ranges of a group, or the values of one range,
    however many rows the group has.
    """
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*group, value)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_range", F.floor(F.col(value) / F.lit(coarse)))
    )
    by_group = Window.partitionBy(*group)
    ranges = (
        counts.groupBy(*group, "_range")
        .agg(F.sum("_n").alias("_range_n"))
        .withColumn("_upto", F.sum("_range_n").over(by_group.orderBy("_range")))
        .withColumn("_total", F.sum("_range_n").over(by_group))
        .withColumn("_percent", F.explode(F.array(*[F.lit(p) for p in percents])))
        # rank = ceil(total * percent / 100), at least 1, in whole numbers
        .withColumn("_want", F.greatest(F.lit(1), F.expr("(_total * _percent + 99) div 100")))
        .where("_want <= _upto AND _want > _upto - _range_n")
        .withColumn("_want", F.col("_want") - (F.col("_upto") - F.col("_range_n")))
        .select(*group, "_range", "_percent", "_want")
    )
    in_range = Window.partitionBy(*group, "_range").orderBy(value)
    found = (
        counts.withColumn("_upto", F.sum("_n").over(in_range))
        .join(ranges, [*group, "_range"])
        .where("_want <= _upto AND _want > _upto - _n")
    )
    return found.groupBy(*group).agg(
        *[F.max(F.when(F.col("_percent") == p, F.col(value))).alias(f"p{p}") for p in percents]
    )
