"""The registered queries: one per operator, over whole tables.

Results are flattened for comparison: arrays become joined text and intervals
whole microseconds.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens.functions.values import interval_micros, typed_statistics
from runlens.operators import sampling
from runlens.plans import backfill, index_report, ingest, metrics, reports, retention, root_cause, runs, sketches
from runlens.session import materialise, shared_folder
from runlens.sources.tables import binary_fingerprints, read_stream_table
from runlens.sources.workload_views import WorkloadViews
from runlens.streaming import root_cause as streamed_root_cause

# Reports look back over all of the data.
EVERYTHING = 24 * 400
RUN_NOW_BEFORE_END = timedelta(hours=12)
COMPARE_AT = "2024-01-16 00:00:00"
READ_SINCE, READ_UNTIL = (datetime(2024, 1, d, tzinfo=timezone.utc) for d in (5, 20))
OFFSET_DRAW = 0.37
SAMPLE_SEED = 7


def flat(df: DataFrame) -> DataFrame:
    columns = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.ArrayType):
            c = F.concat_ws("|", c.cast("array<string>"))
        elif isinstance(f.dataType, T.BinaryType):
            c = F.lower(F.hex(c))
        elif isinstance(f.dataType, T.DayTimeIntervalType):
            c = interval_micros(c)
        elif isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz")
        elif isinstance(f.dataType, T.IntegerType):
            c = c.cast("bigint")
        columns.append(c.alias(f.name))
    return df.select(*columns)


def _run_now(v: WorkloadViews):
    return v.latest() - RUN_NOW_BEFORE_END


# ------------------------------------------------------------------------ ingest

def i02_active_runs(v):
    return runs.active_runs(v.runs(), v.state(), _run_now(v))


def i03_watermarks(v):
    return runs.watermarks(v.runs(), v.state()).select("test_run", "stream", "watermark_ts")


def i04_set_watermarks(v):
    now = _run_now(v)
    slices = runs.due_slices(v.runs(), v.state(), now)
    return runs.set_watermarks(v.state(), slices.withColumnRenamed("to_ts", "watermark_ts"), now)


def i05_live_slices(v):
    return runs.due_slices(v.runs(), v.state(), _run_now(v), ("contention", "insights"))


def i06_agg_slices(v):
    return runs.due_slices(v.runs(), v.state(), _run_now(v), ("stmt_stats", "txn_stats"))


def i07_contention(v):
    return v.persisted()["contention"]


def i08_insights_dedupe(v):
    return v.persisted()["insights"]


def i09_txn_id_map(v):
    return v.persisted()["txn_id_map"]


def _upserted(v, stream):
    slices = runs.whole_run_slices(v.runs())
    view = v.stmt_stats if stream == "stmt_stats" else v.txn_stats
    old = ingest.tag_with_runs(view(half_hour=True), slices, stream)
    # the source holds an older version of many buckets beside the newest
    new = ingest.tag_with_runs(view().unionByName(view(half_hour=True)), slices, stream)
    return ingest.merged_statistics(new, old, stream)


def i10_stmt_upsert(v):
    return _upserted(v, "stmt_stats")


def i11_txn_upsert(v):
    return _upserted(v, "txn_stats")


def i15_backfill_candidates(v):
    return backfill.backfill_candidates(v.contention(), v.latest(), EVERYTHING)


def _backfilled(v, both):
    target = v.persisted()["contention"]
    return backfill.backfilled(target, v.contention(resolved=True), v.latest(), EVERYTHING, both)


def i16_backfill_per_column(v):
    return _backfilled(v, False)


def i17_backfill_both(v):
    return _backfilled(v, True)


def _older_runs(v):
    """Runs with the two copy marks of the older ingest."""
    live = F.col("stream") == "contention"
    marks = v.state().groupBy("test_run").agg(
        F.max(F.when(live, F.col("watermark_ts"))).alias("last_copy_time"),
        F.max(F.when(~live, F.col("watermark_ts"))).alias("last_agg_copy_time"),
    )
    return v.runs().join(marks, "test_run", "left")


def i20_older_active_runs(v):
    return runs.older_active_runs(_older_runs(v), _run_now(v)).select("test_run", "last_copy_time", "last_agg_copy_time")


def i22_hour_window(v):
    return runs.hour_windows(_older_runs(v), runs.longest_interval(v.txn_stats()), _run_now(v))


def _counts(v):
    tables = {k: t for k, t in v.persisted().items() if k != "txn_id_map"}
    return ingest.load_counts(tables, runs.whole_run_slices(v.runs()))


def i24_load_counts(v):
    return _counts(v)


def i25_load_summary(v):
    return ingest.load_summary(_counts(v), v.runs())


def s10_summary_json(v):
    return ingest.summary_json(i25_load_summary(v))


def i26_normalise_recs(v):
    stats = v.stmt_stats()
    recs = ingest.normalised_recommendations("index_recommendations", stats.schema["index_recommendations"].dataType)
    plan = ingest.normalised_recommendations("cnt", T.LongType())
    pairs = F.transform("index_recommendations", lambda r: F.struct(r.alias("rec")))
    as_json = ingest.normalised_recommendations(
        pairs, T.ArrayType(T.StructType([T.StructField("rec", T.StringType())]))
    )
    stats = stats.withColumn("cnt", F.expr("cast(get_json_object(statistics, '$.statistics.cnt') as bigint)"))
    return stats.select(
        "aggregated_ts", "fingerprint_id", "plan_hash", "app_name", recs.alias("recs"), plan.alias("one"), as_json.alias("docs")
    )


# --------------------------------------------------------------------- retention

def r01_expire(v):
    return retention.unexpired(v.contention(), "contention", v.latest() + timedelta(days=75))


def r01b_expire_all(v):
    """Rows that every table with a retention time keeps."""
    now = v.latest() + timedelta(days=75)
    tables = {"runs": v.runs(), "ingest_state": v.state(), **v.persisted()}
    parts = [
        retention.unexpired(df, name, now).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        for name, df in tables.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def r02_cascade(v):
    tables = {"runs": v.runs(), "ingest_state": v.state(), **v.persisted()}
    deleted = v.runs().where("database_name = 'other'")
    kept = retention.without_runs(tables, deleted)
    parts = [
        df.groupBy("test_run").agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "test_run", "rows")
        for name, df in kept.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def r03_orphans(v):
    day = F.concat(F.lit("run_"), F.date_format("collection_ts", "yyyyMMdd"))
    child = v.contention().withColumn("test_run", day)
    return retention.orphans(child, v.runs().where("database_name = 'schedules'"))


def r04_duplicates(v):
    slices = runs.whole_run_slices(v.runs())
    return retention.duplicate_keys(ingest.visible_insights(v.insights(), slices), "insights")


def r05_nulls(v):
    return retention.null_counts(v.insights())


# -------------------------------------------------------------------- root cause

def _parsed(v):
    return root_cause.parse_exceptions(v.exceptions(), "timestamp_ntz")


def e01_parse(v):
    return _parsed(v).select("exception_id", "retry_error_type", "contention_key", "conflict_ts", "txn_id_prefix")


def e05_stage1(v):
    p = v.persisted()
    return root_cause.by_contention_event(_parsed(v), p["contention"], p["insights"])


def e05b_stage1_streamed(v):
    """The same stage over streams: files of both sides read once, with a closing row each that lets their time go on."""
    p, folder = v.persisted(), f"{shared_folder(v.spark)}/stage1-{uuid.uuid4().hex}"
    events = p["contention"].withColumn("collection_ts", F.col("collection_ts").cast("timestamp"))
    closing = events.limit(1).withColumns({"test_run": F.lit(""), "collection_ts": F.timestamp_seconds(F.lit(4_000_000_000))})
    errors = v.exceptions()
    last = errors.where("exception_str LIKE '%conflicting txn%'").limit(1)
    last = last.withColumns({"test_run": F.lit(""), "exception_str": F.regexp_replace("exception_str", r"ts=\d+", "ts=4000000000")})
    sides = []
    for name, df in (("events", events.unionByName(closing)), ("errors", errors.unionByName(last))):
        df.write.parquet(f"{folder}/{name}")
        sides.append(v.spark.readStream.schema(df.schema).parquet(f"{folder}/{name}"))
    found = streamed_root_cause.by_contention_event(sides[1], sides[0], p["insights"])
    to = found.writeStream.format("parquet").option("path", f"{folder}/found").option("checkpointLocation", f"{folder}/checkpoint")
    to.trigger(availableNow=True).start().awaitTermination()
    return v.spark.read.schema(found.schema).parquet(f"{folder}/found")


def e07_stage2(v):
    p = v.persisted()
    return root_cause.by_failed_insight(root_cause.involved_transactions(_parsed(v), p["txn_id_map"]), p["insights"])


def e08_stage3(v):
    p = v.persisted()
    return root_cause.by_any_insight(root_cause.involved_transactions(_parsed(v), p["txn_id_map"]), p["insights"])


def _failed(v, p):
    parsed = materialise(_parsed(v).drop("exception_str"), "parsed", shared_folder(v.spark))
    failed = root_cause.failed_statements(parsed, p["contention"], p["insights"], p["txn_id_map"])
    return root_cause.with_arguments(failed, parsed)


def e09_failed_statement(v):
    return _failed(v, v.stored()).drop("test_run", "option")


def _picked(v, p):
    failed = materialise(_failed(v, p), "failed", shared_folder(v.spark))
    return materialise(root_cause.pick_transactions(failed, p["txn_stats"]), "picks", shared_folder(v.spark))


def e12_txn_pick(v):
    return _picked(v, v.stored())


def e13_stmt_order(v):
    p = v.stored()
    return root_cause.statement_order(_picked(v, p), p["txn_stats"])


def e14_asof_stmt(v):
    p = v.stored()
    ordered = root_cause.statement_order(_picked(v, p), p["txn_stats"])
    return root_cause.statement_versions(ordered, p["stmt_stats"])


def _inspected(v):
    return root_cause.inspect_contention(v.exceptions(), ordered=False, **v.stored())


def e17_root_cause(v):
    return _inspected(v)


def _through_reader(v, stream, **bounds):
    """A stream in its storage form, written as files and read by the reader."""
    files = f"{shared_folder(v.spark)}/source-{stream}-{uuid.uuid4().hex}"
    binary_fingerprints(getattr(v, stream)(), stream).write.parquet(files)
    return read_stream_table(v.spark, stream, files, **bounds)


def s01_read_contention(v):
    return _through_reader(v, "contention", since=READ_SINCE, until=READ_UNTIL, database="schedules")


def s02_read_insights(v):
    return _through_reader(v, "insights", since=READ_SINCE)


def s03_read_stmt_stats(v):
    return _through_reader(v, "stmt_stats", until=READ_UNTIL)


def s04_read_txn_stats(v):
    return _through_reader(v, "txn_stats")


def s11_report(v):
    return root_cause.report(_inspected(v), ("exception_id",))


# ----------------------------------------------------------------------- reports

def _sources(v):
    return {"stmt_stats": v.stmt_stats(), "txn_stats": v.txn_stats(), "insights": v.insights(), "contention": v.contention()}


def a00_horizon(v):
    return reports.data_horizon(_sources(v))


def a00b_capacity(v):
    return reports.capacity_use(reports.data_horizon(_sources(v)), v.capacities())


def a01_slow_mean(v):
    return reports.slow_by_mean(v.stmt_stats(), v.latest(), EVERYTHING)


def a02_slow_total(v):
    return reports.slow_by_total(v.stmt_stats(), v.latest(), EVERYTHING)


def a03_full_scans(v):
    return reports.full_scans(v.stmt_stats(), v.latest(), EVERYTHING)


# The same reports over statistics whose documents were typed when they were written.

def _typed(v, stream):
    rows = typed_statistics(getattr(v, stream)(), stream).drop("metadata", "statistics")
    return materialise(rows, f"typed-{stream}", shared_folder(v.spark))


def a01b_slow_mean_typed(v):
    return reports.slow_by_mean(_typed(v, "stmt_stats"), v.latest(), EVERYTHING)


def a02b_slow_total_typed(v):
    return reports.slow_by_total(_typed(v, "stmt_stats"), v.latest(), EVERYTHING)


def a03b_full_scans_typed(v):
    return reports.full_scans(_typed(v, "stmt_stats"), v.latest(), EVERYTHING)


def a18b_failed_txns_typed(v):
    rates = reports.failed_transactions(_typed(v, "txn_stats"), _typed(v, "stmt_stats"), v.latest(), EVERYTHING)
    return rates.withColumn("failed_txn_ratio", F.round("failed_txn_ratio", 6))


def a19b_write_hotspots_typed(v):
    return reports.write_hotspots(_typed(v, "stmt_stats"), v.latest(), EVERYTHING)


def a04_insights(v):
    return reports.flagged_insights(v.insights(), v.latest(), EVERYTHING)


def a05_failed(v):
    return reports.failed_executions(v.insights(), v.latest(), EVERYTHING)


WEIGHTS = index_report.Weights(lookback_hours=EVERYTHING)


def a08_index_scored(v):
    return index_report.scored(index_report.recommended(v.stmt_stats(), v.latest(), WEIGHTS))


def a09_index_agg(v):
    return index_report.aggregated(index_report.recommended(v.stmt_stats(), v.latest(), WEIGHTS))


def a10_existing_indexes(v):
    c = v.catalog()
    return index_report.existing_indexes(c["tables"], c["table_indexes"], c["index_usage_statistics"])


def a11_index_usage(v):
    return index_report.index_usage(a10_existing_indexes(v))


def a14_index_report(v):
    c = v.catalog()
    return index_report.index_opportunities(
        v.stmt_stats(), c["tables"], c["table_indexes"], c["index_usage_statistics"], v.latest(), WEIGHTS
    )


def a15_hot_objects(v):
    return reports.hot_objects(v.contention(), v.latest(), EVERYTHING)


def a16_waiting(v):
    return reports.top_waiting(v.contention(), v.stmt_stats(), v.latest(), EVERYTHING)


def a17_blocking(v):
    return reports.top_blocking(v.contention(), v.latest(), EVERYTHING)


def a18_failed_txns(v):
    rates = reports.failed_transactions(v.txn_stats(), v.stmt_stats(), v.latest(), EVERYTHING)
    return rates.withColumn("failed_txn_ratio", F.round("failed_txn_ratio", 6))


def a19_write_hotspots(v):
    return reports.write_hotspots(v.stmt_stats(), v.latest(), EVERYTHING)


def a20_slow_performers(v):
    return reports.slow_performers(v.stmt_stats(), None, "app1")


def a21_random_sample(v):
    return sampling.random_sample(v.table("orders").select("o_orderkey"), "o_orderkey", 16, SAMPLE_SEED)


def a22_offset_sample(v):
    orders = v.table("orders").select("o_orderkey")
    return sampling.offset_slice(orders, "o_orderkey", sampling.random_offset(orders.count(), OFFSET_DRAW), 16)


def a23_latency(v):
    ops = v.events().select(F.col("event_type").alias("op"), F.col("cents").alias("latency_us"), "user_id")
    return reports.latency_summary(ops, thread="user_id", elapsed_seconds=3600.0)


def a23b_latency_sketched(v):
    """Percentiles and user counts from hourly sketches, and whether they are within the stated errors of the exact ones."""
    ops = v.events().select("ts", F.col("event_type").alias("op"), F.col("cents").alias("latency"), "user_id")
    found = sketches.summary(sketches.hourly(ops, ["op"], "ts", "latency", "user_id"), ["op"])
    percents, error = (50, 90, 95, 99), sketches.RANK_ERROR
    below = [F.count_if(F.col("latency") < F.col(f"p{p}")).alias(f"_below{p}") for p in percents]
    upto = [F.count_if(F.col("latency") <= F.col(f"p{p}")).alias(f"_upto{p}") for p in percents]
    exact = ops.join(found, "op").groupBy("op").agg(F.count_distinct("user_id").alias("_users"), *below, *upto)
    near = [
        ((F.col(f"_below{p}") <= F.col("n") * (p / 100 + error)) & (F.col(f"_upto{p}") >= F.col("n") * (p / 100 - error))).alias(f"p{p}_near")
        for p in percents
    ]
    users = (F.abs(F.col("members") - F.col("_users")) <= F.col("_users") * sketches.COUNT_ERROR).alias("users_near")
    return found.join(exact, "op").select("op", F.col("n").alias("ops"), F.round("mean", 6).alias("mean"), "max", *near, users)


def a24_run_compare(v):
    half = F.when(F.col("aggregated_ts") < F.lit(COMPARE_AT).cast("timestamp_ntz"), "before").otherwise("after")
    return reports.compare_runs(v.stmt_stats().withColumn("test_run", half), "before", "after")


def a25_keyed_update(v):
    """All keyed updates on orders: those of customers whose balance is negative."""
    orders = v.table("orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz"))
    debtors = v.table("customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    draw = sampling.keyed_draw("o_orderkey", 11)
    changes = {
        "o_orderdate": sampling.shifted_minutes(F.col("o_orderdate"), draw),
        "o_orderstatus": sampling.picked_status(("on_time", "delayed", "cancelled"), draw, 2),
        "o_totalprice": sampling.scaled_price(F.col("o_totalprice"), draw, 3),
    }
    return sampling.update_keyed(orders, debtors, "o_custkey", changes)


def a25b_predicate_update(v):
    return sampling.update_where(
        v.table("customer"), F.col("c_mktsegment") == "MACHINERY", {"c_name": F.lit("renamed")}
    )


# ----------------------------------------------------------------------- metrics

def m01_stream_totals(v):
    return metrics.stream_totals(v.metrics())


def m03_durations(v):
    return metrics.duration_histogram(v.metrics())


def m05_watermark_lag(v):
    now = _run_now(v)
    return runs.watermark_lag(runs.due_slices(v.runs(), v.state(), now, slice_seconds=None), now)


def m06_backfilled(v):
    return backfill.backfilled_rows(_backfilled(v, False))


def m07_alert_errors(v):
    return metrics.alerts(v.metrics(), metrics.INGEST_ERRORS, 60)


def m08_alert_lag(v):
    return metrics.alerts(v.metrics(), metrics.LAG_HIGH, 60)


def _last_sample(v):
    return v.metrics().agg(F.max("ts").alias("ts")).scalar()


def m04_active_runs(v):
    return metrics.active_runs_gauge(runs.active_runs(v.runs(), v.state(), _run_now(v)))


def m09_alert_idle(v):
    return metrics.alerts(v.metrics(), metrics.NOT_INGESTING, 60, _last_sample(v))


def m10_alert_backfill(v):
    return metrics.alerts(v.metrics(), metrics.BACKFILL_STUCK, 60, _last_sample(v))


def _registered() -> dict[str, Callable]:
    import re

    return {n: f for n, f in globals().items() if re.fullmatch(r"[aeimrs]\d\d[a-z]?_\w+", n) and callable(f)}


def build(name: str, spark: SparkSession, folder: str) -> DataFrame:
    return flat(_registered()[name](WorkloadViews(spark, folder)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(f):
        return lambda spark, folder: flat(f(WorkloadViews(spark, folder)))

    return {name: bind(f) for name, f in sorted(_registered().items())}
