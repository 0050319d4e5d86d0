"""Reports over statement statistics, insights, contention and transactions.

Every report takes the table as a DataFrame and ``now`` with a lookback; the
same code serves a live source and a stored run. The time filter compares the
bare column with a literal, so it prunes at the scan, and only the JSON paths
in use are parsed. Ordered reports spell out NULL order and end in a tie-break.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens import schemas as S
from runlens.functions import patterns as P
from runlens.functions.values import (
    exact_sum,
    hours,
    instant,
    interval_ms,
    metadata_of,
    statistics_of,
)
from runlens.operators.ranking import exact_percentiles, top

Now = datetime | Column | None


def recent(df: DataFrame, ts: str, now: Now, lookback_hours: int) -> DataFrame:
    return df.where(F.col(ts) >= instant(now) - hours(lookback_hours))


def _not_internal() -> Column:
    return ~F.col("app_name").like(S.INTERNAL_APPS)


def user_statements(stats: DataFrame, now: Now, lookback_hours: int) -> DataFrame:
    """Recent statistics of user statements, with ``m`` and ``s``.

    A typed table has these columns. Otherwise the filter looks for its one JSON path, and the
    documents are parsed once, for the rows that are left.
    """
    named = F.col("m.db") if "m" in stats.columns else F.get_json_object("metadata", "$.db")
    db = F.coalesce(named, F.lit(""))
    return (
        recent(stats, "aggregated_ts", now, lookback_hours)
        .where(_not_internal() & ~db.isin(*S.SYSTEM_DATABASES))
        .withColumns({"m": metadata_of(stats), "s": statistics_of(stats)})
    )


def _cnt() -> Column:
    return F.col("s.statistics.cnt")


def _ms(path: str) -> Column:
    return F.round(F.col(path) * 1000, 2)


STATEMENT_TIE = ("query", "app_name", "aggregated_ts", "fingerprint_id", "plan_hash")


def _tie(df: DataFrame, names: Sequence[str]) -> list[Column]:
    return [F.col(c).asc_nulls_first() for c in names if c in df.columns]


def _top_statements(df: DataFrame, columns: list[Column], by: str, k: int | None) -> DataFrame:
    ties = [c for c in STATEMENT_TIE if c not in ("query", "app_name")]
    picked = df.select(*columns, *ties)
    ordered = top(picked, [F.col(by).desc_nulls_last(), *_tie(picked, STATEMENT_TIE)], k)
    return ordered.drop(*ties)


def slow_by_mean(stats: DataFrame, now: Now = None, lookback_hours: int = 3, k: int | None = 20) -> DataFrame:
    columns = [
        F.col("m.query").alias("query"),
        F.col("app_name"),
        _cnt().cast("bigint").alias("execs"),
        _ms("s.statistics.runLat.mean").alias("mean_run_ms"),
        _ms("s.statistics.svcLat.mean").alias("mean_svc_ms"),
        _ms("s.execution_statistics.contentionTime.mean").alias("mean_contention_ms"),
        F.round("s.statistics.rowsRead.mean", 1).alias("mean_rows_read"),
        F.col("m.fullScan").alias("full_scan"),
    ]
    return _top_statements(user_statements(stats, now, lookback_hours), columns, "mean_run_ms", k)


def slow_by_total(stats: DataFrame, now: Now = None, lookback_hours: int = 3, k: int | None = 20) -> DataFrame:
    columns = [
        F.col("m.query").alias("query"),
        F.col("app_name"),
        _cnt().cast("bigint").alias("execs"),
        _ms("s.statistics.svcLat.mean").alias("mean_svc_ms"),
        F.round(_cnt() * F.col("s.statistics.svcLat.mean"), 2).alias("total_svc_sec"),
    ]
    return _top_statements(user_statements(stats, now, lookback_hours), columns, "total_svc_sec", k)


def full_scans(stats: DataFrame, now: Now = None, lookback_hours: int = 3, k: int | None = 20) -> DataFrame:
    columns = [
        F.col("m.query").alias("query"),
        F.col("app_name"),
        _cnt().cast("bigint").alias("execs"),
        F.round("s.statistics.rowsRead.mean", 1).alias("mean_rows_read"),
        F.round(_cnt() * F.col("s.statistics.rowsRead.mean"), 0).alias("total_rows_read"),
        _ms("s.statistics.runLat.mean").alias("mean_run_ms"),
        F.col("index_recommendations"),
    ]
    scans = F.col("m.fullScan") if "m" in stats.columns else F.get_json_object("metadata", "$.fullScan") == "true"
    scanning = stats.where(scans)
    return _top_statements(user_statements(scanning, now, lookback_hours), columns, "total_rows_read", k)


def slow_performers(stats: DataFrame, test_run: str | None, app_name: str | None = None, k: int | None = 5) -> DataFrame:
    """Largest mean run time per query text within a run and application."""
    if test_run is not None:
        stats = stats.where(F.col("test_run") == test_run)
    if app_name is not None:
        stats = stats.where(F.col("app_name") == app_name)
    by_query = stats.groupBy(metadata_of(stats)["query"].alias("query")).agg(
        F.max(F.round(statistics_of(stats)["statistics"]["runLat"]["mean"] * 1000, 2)).alias("avg_ms")
    )
    return top(by_query.select("avg_ms", "query"), [F.col("avg_ms").desc_nulls_last(), F.col("query")], k)


# ----------------------------------------------------------------------- horizon

def data_horizon(sources: dict[str, DataFrame]) -> DataFrame:
    """Rows, oldest and newest time and their span, per source.

    ``sources`` maps a stream to its table; only the time column is read.
    """
    out = None
    for stream, df in sources.items():
        ts = S.EVENT_TIME[stream]
        part = df.agg(
            F.count(F.lit(1)).alias("rows"),
            F.min(ts).cast("timestamp_ntz").alias("oldest"),
            F.max(ts).cast("timestamp_ntz").alias("newest"),
        ).select(F.lit(S.SOURCE_NAMES[stream]).alias("source"), "*", (F.col("newest") - F.col("oldest")).alias("span"))
        out = part if out is None else out.unionByName(part)
    return out


def capacity_use(horizon: DataFrame, caps: DataFrame, full_at: float = 0.95) -> DataFrame:
    """Row count against the cap of each source; near the cap rows are evicted."""
    use = F.try_divide(F.col("rows").cast("double"), F.col("capacity").cast("double"))
    return horizon.join(caps, "source").select(
        "source", "rows", "capacity", use.alias("used"), (use >= full_at).alias("evicting")
    )


# ---------------------------------------------------------------------- insights

def flagged_insights(insights: DataFrame, now: Now = None, lookback_hours: int = 3, k: int | None = 25) -> DataFrame:
    grouped = (
        recent(insights, "start_time", now, lookback_hours)
        .where(_not_internal())
        .groupBy("problem", "causes", "query", "app_name")
        .agg(
            F.count(F.lit(1)).alias("occurrences"),
            interval_ms(F.sum("contention")).alias("total_contention_ms"),
            F.sum("rows_read").alias("rows_read"),
            F.max("retries").alias("max_retries"),
            F.bool_or("full_scan").alias("any_full_scan"),
        )
    )
    order = [
        F.col("occurrences").desc(),
        F.col("total_contention_ms").desc_nulls_last(),
        *_tie(grouped, ("problem", "query", "app_name", "causes")),
    ]
    return top(grouped, order, k)


def failed_executions(insights: DataFrame, now: Now = None, lookback_hours: int = 3, k: int | None = 25) -> DataFrame:
    failed = recent(insights, "start_time", now, lookback_hours).where(
        (F.col("status") == "Failed") & _not_internal()
    )
    columns = ["start_time", "app_name", "query", "status", "error_code", "last_retry_reason", "retries"]
    picked = failed.select(*columns, "stmt_id", "txn_id")
    order = [F.col("start_time").desc(), *_tie(picked, ("app_name", "query", "stmt_id", "txn_id"))]
    return top(picked, order, k).drop("stmt_id", "txn_id")


# -------------------------------------------------------------------- contention

def hot_objects(contention: DataFrame, now: Now = None, lookback_hours: int = 3, k: int | None = 20) -> DataFrame:
    grouped = (
        recent(contention, "collection_ts", now, lookback_hours)
        .groupBy("database_name", "schema_name", "table_name", "index_name", "contention_type")
        .agg(
            F.count(F.lit(1)).alias("events"),
            interval_ms(F.sum("contention_duration")).alias("total_contention_ms"),
            interval_ms(F.max("contention_duration")).alias("max_contention_ms"),
        )
        .withColumn("index_name", F.coalesce("index_name", F.lit("(primary or n/a)")))
    )
    names = ("database_name", "schema_name", "table_name", "index_name", "contention_type")
    return top(grouped, [F.col("total_contention_ms").desc_nulls_last(), *_tie(grouped, names)], k)


def top_waiting(
    contention: DataFrame,
    stats: DataFrame,
    now: Now = None,
    lookback_hours: int = 3,
    k: int | None = 20,
    dedupe_fingerprints: bool = False,
) -> DataFrame:
    """Statements that wait most on locks.

    Joining each event to every statistics row of its fingerprint multiplies
    counts and times by the number of those rows. The same figures come from
    two sums per fingerprint joined one to one, so no event is ever repeated;
    ``dedupe_fingerprints`` leaves the multiplication out.
    """
    waits = (
        recent(contention, "collection_ts", now, lookback_hours)
        .groupBy("waiting_stmt_fingerprint_id")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("contention_duration").alias("waited"))
    )
    texts = stats.groupBy("fingerprint_id").agg(
        F.count(F.lit(1)).alias("copies"), F.min(metadata_of(stats)["query"]).alias("sample_query")
    )
    times = F.lit(1) if dedupe_fingerprints else F.coalesce("copies", F.lit(1))
    joined = waits.join(texts, waits["waiting_stmt_fingerprint_id"] == texts["fingerprint_id"], "left").select(
        F.col("waiting_stmt_fingerprint_id").alias("waiting_stmt_fp"),
        (F.col("n") * times).cast("bigint").alias("wait_events"),
        F.round(F.col("waited").cast("decimal(20,6)") * 1000 * times, 2).cast("double").alias("total_wait_ms"),
        "sample_query",
    )
    return top(joined, [F.col("total_wait_ms").desc_nulls_last(), *_tie(joined, ("waiting_stmt_fp",))], k)


def top_blocking(contention: DataFrame, now: Now = None, lookback_hours: int = 3, k: int | None = 20) -> DataFrame:
    """Transactions that block others most; summed per victim first, so one
    blocking fingerprint with most of the events is spread over its victims."""
    per_victim = (
        recent(contention, "collection_ts", now, lookback_hours)
        .groupBy("blocking_txn_fingerprint_id", "waiting_txn_fingerprint_id")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("contention_duration").alias("blocked"))
    )
    grouped = per_victim.groupBy(F.col("blocking_txn_fingerprint_id").alias("blocking_txn_fp")).agg(
        F.sum("n").alias("times_blocking"),
        interval_ms(F.sum("blocked")).alias("total_blocking_ms"),
        F.count("waiting_txn_fingerprint_id").alias("distinct_victims"),
    )
    return top(grouped, [F.col("total_blocking_ms").desc_nulls_last(), *_tie(grouped, ("blocking_txn_fp",))], k)


# ------------------------------------------------------------------ transactions

def failed_transactions(
    txn_stats: DataFrame, stmt_stats: DataFrame, now: Now = None, lookback_hours: int = 3, ordered: bool = True
) -> DataFrame:
    """Failure rate of transactions from the failures of their statements.

    Each statistics row of a transaction meets the roll-up over the whole
    lookback, as there is no time bucket in the join.
    """
    rollup = (
        user_statements(stmt_stats, now, lookback_hours)
        .groupBy("app_name", "transaction_fingerprint_id")
        .agg(
            F.sum(_cnt().cast("bigint")).alias("stmt_execs"),
            F.sum(F.coalesce(F.col("s.statistics.failureCount"), F.lit(0)).cast("bigint")).alias(
                "failed_stmt_execs"
            ),
        )
    )
    txns = (
        recent(txn_stats, "aggregated_ts", now, lookback_hours)
        .where(_not_internal())
        .select(
            F.col("fingerprint_id").alias("txn_fingerprint_id"),
            F.array_size(metadata_of(txn_stats, True)["stmtFingerprintIDs"]).cast("bigint").alias("num_stmt"),
            "app_name",
            statistics_of(txn_stats)["statistics"]["cnt"].cast("bigint").alias("tx_execs"),
        )
    )
    ratio = F.try_divide(
        F.col("failed_stmt_execs").cast("decimal(19,0)"), F.col("tx_execs").cast("decimal(19,0)")
    )
    joined = txns.join(
        rollup.withColumnRenamed("transaction_fingerprint_id", "txn_fingerprint_id"),
        ["app_name", "txn_fingerprint_id"],
    ).select(
        "txn_fingerprint_id",
        "num_stmt",
        "app_name",
        "tx_execs",
        "stmt_execs",
        "failed_stmt_execs",
        F.when(F.col("failed_stmt_execs") == 0, "NEVER")
        .when(ratio < 1, "SOMETIMES")
        .otherwise("ALWAYS")
        .alias("failure_rate"),
        ratio.alias("failed_txn_ratio"),
    )
    if not ordered:
        return joined
    return joined.orderBy(F.col("tx_execs").desc_nulls_last(), "txn_fingerprint_id", "app_name")


def write_hotspots(stats: DataFrame, now: Now = None, lookback_hours: int = 2) -> DataFrame:
    """Approximate rows written per table, read from the DML texts."""
    written = F.coalesce("s.statistics.rowsWritten.mean", F.lit(0.0))
    text = F.coalesce("m.query", "m.querySummary")
    named = (
        user_statements(stats, now, lookback_hours)
        .where(written > 0)
        .select(text.alias("qry"), (_cnt() * written).alias("rows"))
        # one text has many statistics rows: sum first, match the patterns once
        .groupBy("qry")
        .agg(exact_sum("rows").alias("rows"))
        .withColumn("table_identifier", P.written_table(F.col("qry")))
        .where("table_identifier IS NOT NULL")
    )
    for schema in S.SYSTEM_DATABASES:
        named = named.where(~F.col("table_identifier").like(f"{schema}.%"))
    return (
        named.groupBy("table_identifier")
        .agg(F.round(F.sum("rows")).cast("bigint").alias("approx_rows_written"))
        .select("table_identifier", P.leaf_name(F.col("table_identifier")).alias("table_name"), "approx_rows_written")
        .orderBy(F.col("approx_rows_written").desc_nulls_last(), "table_identifier")
    )


# ------------------------------------------------------------------- comparisons

def latency_summary(
    operations: DataFrame,
    op: str = "op",
    latency: str = "latency_us",
    thread: str | None = None,
    elapsed_seconds: float | None = None,
) -> DataFrame:
    """Per operation: threads, count, rate, mean, percentiles and maximum.

    ``latency`` is a whole number of units; percentiles are exact nearest ranks.
    """
    aggregates = [
        F.count(F.lit(1)).alias("ops"),
        F.avg(latency).alias("mean"),
        F.max(latency).alias("max"),
    ]
    if thread is not None:
        aggregates.insert(0, F.count_distinct(thread).alias("threads"))
    totals = operations.groupBy(op).agg(*aggregates)
    if elapsed_seconds is not None:
        totals = totals.withColumn("ops_per_second", F.col("ops") / F.lit(float(elapsed_seconds)))
    ranks = exact_percentiles(operations.select(op, latency), [op], latency, (50, 90, 95, 99))
    return totals.join(ranks, op, "left")


def compare_runs(stats: DataFrame, base: str, other: str) -> DataFrame:
    """Executions and mean times per statement in two runs, and their change.

    One aggregation over both runs does the work of a full outer join.
    """
    s = statistics_of(stats)["statistics"]
    slim = stats.where(F.col("test_run").isin(base, other)).select(
        "test_run",
        "app_name",
        "fingerprint_id",
        s["cnt"].alias("cnt"),
        (s["cnt"] * s["runLat"]["mean"]).alias("run"),
        (s["cnt"] * s["svcLat"]["mean"]).alias("svc"),
    )
    sums = []
    for label, run in (("base", base), ("other", other)):
        mine = F.col("test_run") == run
        sums += [exact_sum(F.when(mine, F.col(c))).cast("double").alias(f"{label}_{c}") for c in ("cnt", "run", "svc")]
    wide = slim.groupBy("app_name", "fingerprint_id").agg(*sums)
    for label in ("base", "other"):
        for c in ("run", "svc"):
            wide = wide.withColumn(f"{label}_mean_{c}", F.try_divide(f"{label}_{c}", f"{label}_cnt"))
    return wide.select(
        "app_name",
        "fingerprint_id",
        F.col("base_cnt").cast("bigint").alias("base_execs"),
        F.col("other_cnt").cast("bigint").alias("other_execs"),
        "base_mean_run",
        "other_mean_run",
        (F.col("other_mean_run") - F.col("base_mean_run")).alias("run_change"),
        "base_mean_svc",
        "other_mean_svc",
        (F.col("other_mean_svc") - F.col("base_mean_svc")).alias("svc_change"),
    )
