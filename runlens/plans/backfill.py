"""Later replacement of placeholder fingerprints in contention events."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions.values import hours, instant, is_known, is_placeholder

WINDOW_HOURS = 2
BLOCKING = "blocking_txn_fingerprint_id"
WAITING = "waiting_txn_fingerprint_id"
EVENT_KEY = ("collection_ts", "blocking_txn_id", "waiting_txn_id")


def backfill_candidates(
    source: DataFrame, now: datetime | Column | None = None, window_hours: int = WINDOW_HOURS
) -> DataFrame:
    """Recent source rows in which at least one fingerprint is resolved."""
    recent = F.col("collection_ts") >= instant(now) - hours(window_hours)
    return source.where(recent & (is_known(F.col(BLOCKING)) | is_known(F.col(WAITING)))).select(
        *EVENT_KEY, BLOCKING, WAITING
    )


def _fixes(candidates: DataFrame, both_columns: bool) -> DataFrame:
    """One row per event with the values to put in for either placeholder.

    ``_via_b`` holds the pair of values used when the blocking side is open,
    ``_via_w`` the pair used when only the waiting side is.
    """
    b, w = F.col(BLOCKING), F.col(WAITING)
    if both_columns:
        via_b = F.min(F.when(is_known(b), F.struct((~is_known(w)).alias("open"), b.alias("b"), w.alias("w"))))
        via_w = F.min(F.when(is_known(w), F.struct((~is_known(b)).alias("open"), b.alias("b"), w.alias("w"))))
    else:
        via_b = F.min(F.when(is_known(b), F.struct(b.alias("b"))))
        via_w = F.min(F.when(is_known(w), F.struct(w.alias("w"))))
    return candidates.groupBy(*EVENT_KEY).agg(via_b.alias("_via_b"), via_w.alias("_via_w"))


def backfilled(
    target: DataFrame,
    source: DataFrame,
    now: datetime | Column | None = None,
    window_hours: int = WINDOW_HOURS,
    both_columns: bool = False,
) -> DataFrame:
    """The contention table after the backfill, with ``changed`` marking new values.

    By default each fingerprint is replaced on its own, and only a placeholder
    by a resolved value. ``both_columns`` overwrites both as soon as either
    qualifies. Rows without a placeholder, or older than the window, do not
    take part in the join and are not shuffled.
    """
    recent = F.col("collection_ts") >= instant(now) - hours(window_hours)
    open_row = recent & (is_placeholder(F.col(BLOCKING)) | is_placeholder(F.col(WAITING)))
    open_row = F.coalesce(open_row, F.lit(False))
    fixes = _fixes(backfill_candidates(source, now, window_hours), both_columns)
    joined = target.where(open_row).join(fixes, list(EVENT_KEY), "left")
    b, w = F.col(BLOCKING), F.col(WAITING)
    fix_b = F.coalesce(is_placeholder(b), F.lit(False)) & F.col("_via_b").isNotNull()
    fix_w = F.coalesce(is_placeholder(w), F.lit(False)) & F.col("_via_w").isNotNull()
    if both_columns:
        pair = F.when(fix_b, F.col("_via_b")).when(fix_w, F.col("_via_w"))
        new_b = F.when(fix_b | fix_w, pair["b"]).otherwise(b)
        new_w = F.when(fix_b | fix_w, pair["w"]).otherwise(w)
    else:
        new_b = F.when(fix_b, F.col("_via_b")["b"]).otherwise(b)
        new_w = F.when(fix_w, F.col("_via_w")["w"]).otherwise(w)
    values = {BLOCKING: new_b, WAITING: new_w}
    done = joined.select(
        *[values.get(c, F.col(c)).alias(c) for c in target.columns], (fix_b | fix_w).alias("changed")
    )
    return target.where(~open_row).withColumn("changed", F.lit(False)).unionByName(done)


def backfilled_rows(result: DataFrame) -> DataFrame:
    """Number of changed rows per run."""
    return result.where("changed").groupBy("test_run").agg(F.count(F.lit(1)).alias("rows"))
