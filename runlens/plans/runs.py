"""Test-run registry, ingest state and the time slices that are due."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens import schemas as S
from runlens.functions.values import instant, seconds, truncated
from runlens.operators.merging import insert_ignore, upsert

SLICE_SECONDS = 30
SAFETY_DELAY_SECONDS = 5


def default_grace() -> Column:
    return F.expr(f"make_dt_interval(0, 0, {S.DEFAULT_GRACE_MINUTES}, 0)")


def register_runs(registry: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(registry with the new runs, refused runs)``.

    A missing grace interval takes the default. A run whose name exists, or
    that lacks a required value, is refused; of two new ones the earlier wins.
    """
    if "agg_grace_interval" in new.columns:
        grace = F.coalesce("agg_grace_interval", default_grace())
    else:
        grace = default_grace()
    required = ("test_run", "database_name", "start_time", "end_time")
    complete = F.lit(True)
    for c in required:
        complete = complete & F.col(c).isNotNull()
    new = new.select(*required, grace.alias("agg_grace_interval"))
    good = insert_ignore(
        new.where(complete),
        registry,
        {"test_run": F.col("test_run")},
        [F.col("start_time"), F.col("end_time"), F.col("database_name")],
    )
    refused = new.exceptAll(good)
    return registry.select(*good.columns).unionByName(good), refused


def active_runs(runs: DataFrame, state: DataFrame, now: datetime | Column | None = None) -> DataFrame:
    """Started runs that are inside their grace time or not yet read to its end."""
    at = instant(now)
    marks = state.groupBy("test_run").agg(F.min("watermark_ts").alias("min_watermark"))
    closes = F.col("end_time") + F.col("agg_grace_interval")
    return (
        runs.where(F.col("start_time") <= at)
        .join(marks, "test_run", "left")
        .where((at <= closes) | F.col("min_watermark").isNull() | (F.col("min_watermark") < closes))
        .select(*runs.columns, "min_watermark")
    )


def watermarks(runs: DataFrame, state: DataFrame, streams: Sequence[str] = S.ALL_STREAMS) -> DataFrame:
    """Every run and stream with its watermark, NULL where nothing was read yet."""
    unknown = set(streams) - set(S.ALL_STREAMS)
    if unknown:
        raise ValueError(f"unknown stream {sorted(unknown)}")
    pairs = runs.withColumn("stream", F.explode(F.array(*[F.lit(s) for s in streams])))
    marks = state.select("test_run", "stream", "watermark_ts")
    return pairs.join(marks, ["test_run", "stream"], "left")


def set_watermarks(state: DataFrame, marks: DataFrame, now: datetime | Column | None = None) -> DataFrame:
    """State after moving the marks ``(test_run, stream, watermark_ts)``."""
    moved = marks.select("test_run", "stream", "watermark_ts", instant(now).alias("updated_at"))
    return upsert(
        moved,
        state,
        S.KEYS["ingest_state"],
        ("watermark_ts", "updated_at"),
        [F.col("watermark_ts").desc()],
    )


def due_slices(
    runs: DataFrame,
    state: DataFrame,
    now: datetime | Column | None = None,
    streams: Sequence[str] = S.ALL_STREAMS,
    slice_seconds: int | None = SLICE_SECONDS,
    safety_delay: int = SAFETY_DELAY_SECONDS,
) -> DataFrame:
    """Half-open slices ``[from_ts, to_ts)`` per run and stream that can be read now.

    A slice starts at the watermark (or the run's start) and ends at the
    earliest of start + ``slice_seconds``, now - ``safety_delay`` and the
    stream's own end: the run's end for live streams, plus the grace interval
    for aggregates. Slices are adjacent, so ``slice_seconds=None`` takes all
    that is due in one slice with the same rows as many small ones.
    """
    begin = F.coalesce("watermark_ts", "start_time")
    is_agg = F.col("stream").isin(*S.AGG_STREAMS)
    cap = F.when(is_agg, F.col("end_time") + F.col("agg_grace_interval")).otherwise(F.col("end_time"))
    ends = [instant(now) - seconds(safety_delay), cap]
    if slice_seconds is not None:
        ends.append(begin + seconds(slice_seconds))
    return (
        watermarks(runs, state, streams)
        .select(
            "test_run",
            "stream",
            "database_name",
            begin.alias("from_ts"),
            F.least(*ends).alias("to_ts"),
        )
        .where(F.col("to_ts") > F.col("from_ts"))
    )


def whole_run_slices(runs: DataFrame, streams: Sequence[str] = S.ALL_STREAMS) -> DataFrame:
    """One slice per run and stream over all it may ever read."""
    is_agg = F.col("stream").isin(*S.AGG_STREAMS)
    return runs.withColumn("stream", F.explode(F.array(*[F.lit(s) for s in streams]))).select(
        "test_run",
        "stream",
        "database_name",
        F.col("start_time").alias("from_ts"),
        F.when(is_agg, F.col("end_time") + F.col("agg_grace_interval"))
        .otherwise(F.col("end_time"))
        .alias("to_ts"),
    )


def watermark_lag(slices: DataFrame, now: datetime | Column | None = None) -> DataFrame:
    """Seconds between now and the end of what was read, per run and stream."""
    at = instant(now)
    micros = F.unix_micros(at.cast("timestamp")) - F.unix_micros(F.col("to_ts").cast("timestamp"))
    return slices.select("test_run", "stream", "to_ts", (micros / 1_000_000).alias("lag_seconds"))


# --- the older rules: hour-aligned windows -------------------------------------

def older_active_runs(runs: DataFrame, now: datetime | Column | None = None) -> DataFrame:
    """Started runs with a copy mark that is missing or before the run's end."""
    unread = lambda c: F.col(c).isNull() | (F.col(c) < F.col("end_time"))
    return runs.where(
        (F.col("start_time") <= instant(now)) & (unread("last_copy_time") | unread("last_agg_copy_time"))
    )


def older_slice_end(end: Column, now: datetime | Column | None = None) -> Column:
    """The earlier of now - 10 s and the run's end + 10 min."""
    return F.least(instant(now) - seconds(10), end + seconds(600))


def longest_interval(stats: DataFrame) -> Column:
    """The longest aggregation interval of the statistics, as a value found when the query runs."""
    return stats.agg(F.max("aggregation_interval").alias("longest")).scalar()


def hour_windows(
    runs: DataFrame, longest_interval: Column, now: datetime | Column | None = None
) -> DataFrame:
    """Hour-aligned aggregate windows of the runs that are ready to be read.

    The window starts at the full hour of the last mark (or the run's start).
    It ends at the full hour of the slice end if that is later, else at the
    slice end itself. A run is ready once the window's age reaches the longest
    aggregation interval plus a sixth of it.
    """
    dtype = runs.schema["start_time"].dataType
    at = instant(now)
    from_raw = F.coalesce("last_agg_copy_time", "start_time")
    to_raw = older_slice_end(F.col("end_time"), now)
    begin = truncated("hour", F.col("_from"), dtype)
    full = truncated("hour", F.col("_to"), dtype)
    return (
        runs.withColumns({"_from": from_raw, "_to": to_raw})
        .where(F.col("_from") < F.col("_to"))
        .withColumns({"from_ts": begin, "_full": full})
        .withColumn("to_ts", F.when(F.col("from_ts") < F.col("_full"), F.col("_full")).otherwise(F.col("_to")))
        .where((at - F.col("from_ts")) >= longest_interval * F.lit(7) / F.lit(6))
        .select("test_run", "database_name", "from_ts", "to_ts")
    )
