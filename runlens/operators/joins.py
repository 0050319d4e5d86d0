"""Joins that Spark has no operator for, built from equi-joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def time_slot(ts: Column, width_seconds: int) -> Column:
    """Number of the fixed-width slot a timestamp falls in."""
    return F.floor(F.unix_micros(ts.cast("timestamp")) / F.lit(width_seconds * 1_000_000))


def interval_join(
    events: DataFrame,
    intervals: DataFrame,
    ts: str,
    lower: str,
    upper: str,
    equal: Sequence[tuple[str, str]] = (),
    slot_seconds: int = 3600,
) -> DataFrame:
    """Events with ``lower <= ts < upper`` of every matching interval.

    Both sides carry a time slot, so the range becomes an equi-join on
    (equal columns, slot) with the exact range as a residual. Columns of the
    interval side come along except those named in ``equal``.
    """
    keep = [c for c in intervals.columns if c not in {r for _, r in equal}]
    last = F.col(upper).cast("timestamp") - F.expr("INTERVAL '0.000001' SECOND")
    spread = (
        intervals.where(F.col(lower) < F.col(upper))
        .withColumn(
            "_slot",
            F.explode(F.sequence(time_slot(F.col(lower), slot_seconds), time_slot(last, slot_seconds))),
        )
        .select("_slot", *[F.col(r).alias(f"_eq_{i}") for i, (_, r) in enumerate(equal)], *keep)
    )
    slotted = events.withColumn("_slot", time_slot(F.col(ts), slot_seconds))
    condition = slotted["_slot"] == spread["_slot"]
    for i, (left, _) in enumerate(equal):
        condition &= slotted[left] == spread[f"_eq_{i}"]
    condition &= (slotted[ts] >= spread[lower]) & (slotted[ts] < spread[upper])
    return slotted.join(spread, condition).select(
        *[slotted[c] for c in events.columns], *[spread[c] for c in keep]
    )


def latest_at_or_before(
    probes: DataFrame,
    points: DataFrame,
    keys: Sequence[str],
    bound: str,
    point_ts: str,
    out: str,
    slot_seconds: int = 3600,
) -> DataFrame:
    """As-of lookup: for each probe the latest ``point_ts <= bound`` of its key.

    Probes without a match are dropped. Probes and points are put in one order
    per (keys, time slot), where each probe takes the last point before it; if the
    slot has none, the latest point of an earlier slot counts, found on one row
    per key and slot. Nothing is gathered into arrays, and a key that holds most
    probes is spread over its slots.
    """
    point_type = points.schema[point_ts].dataType
    slot = lambda c: time_slot(F.col(c), slot_seconds)
    extra = [c for c in probes.columns if c not in keys]
    void = [F.lit(None).cast(probes.schema[c].dataType).alias(c) for c in extra]
    stamp = F.col(point_ts)
    held = points.select(*keys, slot(point_ts).alias("_slot"), stamp.alias("_at"), stamp.alias("_point")).distinct()
    pts = held.select("*", *void, F.lit(False).alias("_asked"))
    asked = probes.select(
        *keys, slot(bound).alias("_slot"), F.col(bound).cast(point_type).alias("_at"),
        F.lit(None).cast(point_type).alias("_point"), *extra, F.lit(True).alias("_asked"),
    ).where("_at IS NOT NULL")
    in_slot = Window.partitionBy(*keys, "_slot").orderBy("_at").rangeBetween(Window.unboundedPreceding, 0)
    within = pts.unionByName(asked).withColumn("_within", F.max("_point").over(in_slot)).where("_asked")
    by_key = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = asked.select(*keys, "_slot", "_point")
    older = (
        held.select(*keys, "_slot", "_point").unionByName(slots)
        .groupBy(*keys, "_slot").agg(F.max("_point").alias("_last"))
        .withColumn("_older", F.max("_last").over(by_key))
        .drop("_last")
    )
    return (
        within.join(older, [*keys, "_slot"])
        .withColumn(out, F.coalesce("_within", "_older"))
        .where(F.col(out).isNotNull())
        .select(*probes.columns, out)
    )


def prefix_join(ids: DataFrame, probes: DataFrame, id_column: str, prefix_column: str, equal: Sequence[str]) -> DataFrame:
    """Rows of ``ids`` and ``probes`` whose id starts with the prefix, case of the id ignored.

    The probes' lengths are found first, as one value of the plan. Ids are read once and cut to each of these
    lengths, and the join is on ``equal`` and the cut, so it meets matches only: a short or garbled
    prefix brings no candidates for the others. Usual prefixes are of one length, then no id is repeated.
    Column names of both sides other than ``equal`` must differ.
    """
    asked = probes.where(F.length(prefix_column) > 0).withColumn("_size", F.length(prefix_column))
    sizes = asked.agg(F.array_sort(F.collect_set("_size")).alias("sizes")).scalar()
    cut = (
        ids.withColumn("_text", F.lower(id_column))
        .withColumn("_size", F.explode(sizes))
        .where(F.col("_size") <= F.length("_text"))
        .withColumn("_key", F.substring(F.col("_text"), F.lit(1), F.col("_size")))
        .drop("_text")
    )
    met = cut.join(asked.withColumn("_key", F.col(prefix_column)), [*equal, "_size", "_key"])
    return met.drop("_size", "_key")
