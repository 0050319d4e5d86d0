"""Ingest metrics kept as a table, and the alert rules over it.

One row per micro-batch: ts, stream, test_run, rows, errors, duration_ms,
lag_seconds, backfilled. Figures are increments, so a rate is a sum.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.schemas import flat_schema

METRICS = flat_schema(
    "ts TIMESTAMP, stream STRING, test_run STRING, rows BIGINT, errors BIGINT, "
    "duration_ms BIGINT, lag_seconds DOUBLE, backfilled BIGINT"
)
CHUNK_SECONDS = 86_400


@dataclass(frozen=True)
class Rule:
    """An alert: ``condition`` over ``range_seconds``, held for ``for_seconds``."""

    name: str
    series: tuple[str, ...]
    value: str
    condition: str
    range_seconds: int
    for_seconds: int
    severity: str


# ---------------------------------------------------------------- fixed values
INGEST_ERRORS = Rule("ObsDaemonIngestErrors", ("stream",), "errors", "increase", 300, 120, "warning")
LAG_HIGH = Rule("ObsDaemonWatermarkLagHigh", ("stream", "test_run"), "lag_seconds", "above_180", 300, 300, "warning")
NOT_INGESTING = Rule("ObsDaemonNotIngesting", ("stream",), "rows", "none", 600, 600, "warning")
BACKFILL_STUCK = Rule("ObsDaemonBackfillStuck", ("test_run",), "backfilled", "none", 1800, 3600, "info")
RULES = (INGEST_ERRORS, LAG_HIGH, NOT_INGESTING, BACKFILL_STUCK)
LAG_LIMIT_SECONDS = 180
# ------------------------------------------------------------ end fixed values


def stream_totals(metrics: DataFrame) -> DataFrame:
    """Rows, errors and time spent per stream."""
    return metrics.groupBy("stream").agg(
        F.sum("rows").alias("rows"),
        F.sum("errors").alias("errors"),
        F.count("duration_ms").alias("batches"),
        F.sum("duration_ms").alias("duration_ms"),
    )


def duration_histogram(metrics: DataFrame, edges_ms: tuple[int, ...] = (5, 10, 25, 50, 75, 100, 250, 500, 750, 1000, 2500, 5000, 7500, 10000)) -> DataFrame:
    """Cumulative counts of batch durations per stream: rows (stream, le_ms, batches).

    The last row of a stream has no upper edge (``le_ms`` NULL).
    """
    d = F.col("duration_ms")
    edges = [*edges_ms, None]
    counts = metrics.where(d.isNotNull()).groupBy("stream").agg(
        *[F.count_if(d <= e if e is not None else d.isNotNull()).alias(f"_{i}") for i, e in enumerate(edges)]
    )
    entries = F.array(
        *[F.struct(F.lit(e).cast("bigint").alias("le_ms"), F.col(f"_{i}").alias("batches")) for i, e in enumerate(edges)]
    )
    return counts.select("stream", F.inline(entries))


def backfilled_per_run(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("test_run").agg(F.sum("backfilled").alias("rows"))


def _step_number(ts: Column, step: int) -> Column:
    """Number of the evaluation step that first sees a sample."""
    return F.ceil(F.unix_micros(ts.cast("timestamp")) / F.lit(step * 1_000_000))


def active_runs_gauge(active: DataFrame) -> DataFrame:
    """The number of active runs, one row; zero if there is none."""
    return active.agg(F.count(F.lit(1)).alias("active_runs"))


def evaluate(metrics: DataFrame, rule: Rule, step_seconds: int = 15, until: Column | None = None) -> DataFrame:
    """State of a rule at every evaluation step of each series, for a chart; ``alerts`` needs no steps.

    Columns: the series, ``step`` (steps since the epoch), ``holds`` and
    ``firing``. Evaluation runs from the first sample of a series to ``until``
    (a time, such as now; default: its last sample), so that a series which fell
    silent is still evaluated. Looking back is bounded by range + held time, so
    each series is cut into days (or longer chunks, if a rule looks back
    further) that are evaluated apart, with the end of the one before repeated
    as context: a series with most of the samples is spread over its chunks.
    """
    series = list(rule.series)
    step, in_range, held = step_seconds, rule.range_seconds // step_seconds, rule.for_seconds // step_seconds
    context = in_range + held + 1
    chunk = max(CHUNK_SECONDS // step_seconds, context)
    gauge = rule.condition == "above_180"
    value = F.col(rule.value)
    if gauge:
        measured = F.max_by(value, F.struct("ts", value))
    else:
        measured = F.sum(value)
    sampled = (
        metrics.where(value.isNotNull())
        .withColumn("step", _step_number(F.col("ts"), step))
        .groupBy(*series, "step")
        .agg(measured.alias("v"))
    )
    # evaluation steps of a series, generated day by day
    span = sampled.groupBy(*series).agg(F.min("step").alias("first"), F.max("step").alias("last"))
    if until is not None:
        span = span.withColumn("last", F.greatest("last", _step_number(until, step)))
    days = span.withColumn(
        "day", F.explode(F.sequence(F.floor(F.col("first") / chunk), F.floor(F.col("last") / chunk)))
    )
    grid = days.select(
        *series,
        "day",
        F.explode(
            F.sequence(
                F.greatest(F.col("first"), F.col("day") * chunk - context),
                F.least(F.col("last"), F.col("day") * chunk + (chunk - 1)),
            )
        ).alias("step"),
    )
    # samples go to their own day and, near its end, to the next one as context
    own = F.floor(F.col("step") / chunk)
    placed = sampled.withColumn(
        "day", F.explode(F.array_distinct(F.array(own, F.floor((F.col("step") + context) / chunk))))
    )
    joined = grid.join(placed, [*series, "day", "step"], "left")
    w = Window.partitionBy(*series, "day").orderBy("step")
    back = w.rowsBetween(-(in_range - 1), 0)
    if gauge:
        holds = F.coalesce(F.last("v", ignorenulls=True).over(back) > LAG_LIMIT_SECONDS, F.lit(False))
    elif rule.condition == "increase":
        holds = F.coalesce(F.sum("v").over(back), F.lit(0)) > 0
    else:
        holds = F.coalesce(F.sum("v").over(back), F.lit(0)) == 0
    held_rows = w.rowsBetween(-held, 0)
    state = joined.withColumn("holds", holds)
    state = state.withColumn(
        "firing",
        F.bool_and("holds").over(held_rows) & (F.count(F.lit(1)).over(held_rows) == held + 1),
    )
    state = state.withColumn("_before", F.coalesce(F.lag("firing").over(w), F.lit(False)))
    return state.where(F.floor(F.col("step") / chunk) == F.col("day")).select(
        *series, "step", "holds", "firing", "_before"
    )


def holding(metrics: DataFrame, rule: Rule, step_seconds: int = 15, until: Column | None = None) -> DataFrame:
    """The longest spans of evaluation steps over which a rule's condition holds: (series, ``begin``, ``end``), both included.

    The work goes by samples and not by steps: a sample decides a span of steps from its own on, touching spans are
    joined, and between samples nothing is generated, however long a series is silent. Samples are
    joined by chunks of time first, so a series with most of them is spread; of a chunk, spans that are a range apart at
    least are left, so what meets per series is bounded by its time. Figures count as not negative.
    """
    series = list(rule.series)
    in_range = rule.range_seconds // step_seconds
    chunk = max(CHUNK_SECONDS // step_seconds, in_range)
    gauge = rule.condition == "above_180"
    value = F.col(rule.value)
    measured = F.max_by(value, F.struct("ts", value)) if gauge else F.sum(value)
    sampled = (
        metrics.where(value.isNotNull())
        .withColumn("step", _step_number(F.col("ts"), step_seconds))
        .groupBy(*series, "step")
        .agg(measured.alias("v"))
    )
    # where evaluation begins and ends
    last = F.max("step") if until is None else F.greatest(F.max("step"), _step_number(until, step_seconds))
    extent = sampled.groupBy(*series).agg(F.min("step").alias("first"), last.alias("last"))
    # steps that a sample decides: up to the next one for a gauge, over the whole range for a sum
    own = F.floor(F.col("step") / chunk)
    by_step = Window.partitionBy(*series, "chunk").orderBy("step")
    reach = F.col("step") + (in_range - 1)
    if gauge:
        # the beginning of the next chunk comes along, as it may end the last sample's span
        placed = sampled.withColumn("chunk", F.explode(F.array_distinct(F.array(own, F.floor((F.col("step") - in_range) / chunk)))))
        seen = placed.withColumn("_next", F.lead("step").over(by_step)).where(own == F.col("chunk"))
        spans = seen.where(F.col("v") > LAG_LIMIT_SECONDS).withColumn("end", F.least(reach, F.col("_next") - 1))
    else:
        spans = sampled.where("v > 0").withColumns({"chunk": own, "end": reach})
    spans = _joined(spans.select(*series, "chunk", F.col("step").alias("begin"), "end"), [*series, "chunk"])
    spans = _joined(spans.select(*series, "begin", "end"), series)
    bounded = _beside(spans, extent, series, "inner").select(*series, "begin", F.least("end", "last").alias("end"), "last")
    if rule.condition != "none":
        return bounded.select(*series, "begin", "end")
    # the condition holds where nothing was counted: before, between and after the spans
    after = F.lead("begin").over(Window.partitionBy(*series).orderBy("begin"))
    gaps = bounded.select(*series, (F.col("end") + 1).alias("begin"), F.coalesce(after - 1, F.col("last")).alias("end"))
    head = spans.groupBy(*series).agg(F.min("begin").alias("_busy"))
    heads = _beside(extent, head, series, "left").select(
        *series, F.col("first").alias("begin"), F.coalesce(F.col("_busy") - 1, F.col("last")).alias("end")
    )
    return gaps.unionByName(heads).where("begin <= end")


def _beside(left: DataFrame, right: DataFrame, series: list[str], how: str) -> DataFrame:
    """Rows of equal series; a missing name is a name, as it is when grouping."""
    right = right.withColumnsRenamed({c: f"_right_{c}" for c in series})
    equal = F.lit(True)
    for c in series:
        equal &= F.col(c).eqNullSafe(F.col(f"_right_{c}"))
    return left.join(right, equal, how)


def _joined(spans: DataFrame, group: list[str]) -> DataFrame:
    """Spans that overlap or touch as one (gaps and islands)."""
    before = Window.partitionBy(*group).orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*group).orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, 0)
    opens = F.coalesce(F.col("begin") > F.max("end").over(before) + 1, F.lit(True))
    numbered = spans.withColumn("_opens", opens.cast("int")).withColumn("_island", F.sum("_opens").over(upto))
    return numbered.groupBy(*group, "_island").agg(F.min("begin").alias("begin"), F.max("end").alias("end")).drop("_island")


def alerts(metrics: DataFrame, rule: Rule, step_seconds: int = 15, until: Column | None = None) -> DataFrame:
    """The times at which a rule starts to fire: its condition has held for the rule's time, within one span."""
    held = rule.for_seconds // step_seconds
    fired = holding(metrics, rule, step_seconds, until).where(F.col("end") - F.col("begin") >= held)
    dtype = metrics.schema["ts"].dataType
    return fired.select(
        F.lit(rule.name).alias("alert"),
        F.lit(rule.severity).alias("severity"),
        *rule.series,
        F.timestamp_micros((F.col("begin") + held) * F.lit(step_seconds * 1_000_000)).cast(dtype).alias("fired_at"),
    )
