"""Observability tables derived from a general event table.

``events`` (event_id, ts, user_id, event_type, value, props) stands in for a
database workload: errors and clicks are lock waits, errors, purchases and
views are flagged executions, all events together give the per-hour
statistics. The queries of the catalogue run over these views.
"""

from __future__ import annotations

from datetime import datetime
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens import schemas as S
from runlens.plans import ingest
from runlens.plans.runs import whole_run_slices
from runlens.session import materialise_all, shared_folder

STREAM_EVENTS = {
    "contention": ("error", "click"),
    "insights": ("error", "purchase", "view"),
}


def hx(expr: str) -> str:
    return f"lpad(lower(hex(cast({expr} as bigint))), 16, '0')"


def _txn_id(expr: str) -> str:
    # ids whose first characters differ, as random ids have
    return f"reverse({hx(expr)})"


class WorkloadViews:
    """Lazily derived views over ``{folder}/events.parquet``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._tables[name]

    def latest(self) -> datetime:
        """Latest event time: the fixed "now" of the reports."""
        return self._latest

    def events(self) -> DataFrame:
        """Events with the derived attributes all views share."""
        k = "cast(get_json_object(props, '$.k') as bigint)"
        return self.table("events").selectExpr(
            "event_id",
            "cast(ts as timestamp_ntz) as ts",
            "user_id",
            "event_type",
            f"{k} as k",
            "cast(round(value * 100) as bigint) as cents",
            "case when user_id % 10 = 9 then '$ internal-job' else concat('app', user_id % 3) end as app_name",
            f"{hx('256 + user_id % 16')} as tfp",
            f"{hx(f'4096 + (user_id % 16) * 4 + {k} % 4')} as sfp",
            f"case when {k} % 20 = 3 then 'other' else 'schedules' end as database_name",
        )

    # ----------------------------------------------------------- event streams

    def contention(self, resolved: bool = False) -> DataFrame:
        """Lock waits; ``resolved`` as the source shows them some time later,
        with half of the placeholder fingerprints known."""
        b, w = (20, 30) if resolved else (10, 15)
        return (
            self.events()
            .where(F.col("event_type").isin(*STREAM_EVENTS["contention"]))
            .selectExpr(
                "ts as collection_ts",
                f"{_txn_id('event_id + 1')} as blocking_txn_id",
                f"case when event_id % {b} = 0 then '{S.ZERO_FINGERPRINT}' else {hx('256 + k % 16')} end"
                " as blocking_txn_fingerprint_id",
                f"{_txn_id('event_id')} as waiting_txn_id",
                f"case when event_id % {w} = 0 then '{S.ZERO_FINGERPRINT}' else tfp end"
                " as waiting_txn_fingerprint_id",
                "make_dt_interval(0, 0, 0, cents / 1000.0BD) as contention_duration",
                "encode(concat('/k/', k % 5), 'UTF-8') as contending_key",
                "concat('/Table/', 100 + k % 5, '/1/\"', user_id, '\"/0') as contending_pretty_key",
                f"{hx('event_id')} as waiting_stmt_id",
                "sfp as waiting_stmt_fingerprint_id",
                "database_name",
                "case when k % 4 = 3 then 'archive' else 'public' end as schema_name",
                "concat('t', k % 4) as table_name",
                "case when k % 3 = 0 then null else concat('idx_', k % 3) end as index_name",
                "case when k % 2 = 0 then 'LOCK_WAIT' else 'SERIALIZATION_CONFLICT' end as contention_type",
            )
        )

    def insights(self) -> DataFrame:
        return (
            self.events()
            .where(F.col("event_type").isin(*STREAM_EVENTS["insights"]))
            .selectExpr(
                "concat('s', user_id) as session_id",
                f"{_txn_id('event_id')} as txn_id",
                "tfp as txn_fingerprint_id",
                f"{hx('event_id')} as stmt_id",
                "sfp as stmt_fingerprint_id",
                "case when event_type = 'error' then 'FailedExecution' else 'SlowExecution' end as problem",
                "case when k % 3 = 0 then cast(array() as array<string>) when k % 3 = 1 then array('HighContention')"
                " else array('HighContention', 'HighRetryCount') end as causes",
                "case when k % 25 = 0 then 'SELECT _' when k % 25 = 1 then 'SHOW _'"
                " else concat('UPDATE t', k % 4, ' SET a = _') end as query",
                "case when event_type = 'error' then 'Failed' else 'Completed' end as status",
                "ts as start_time",
                "ts + interval 1500 milliseconds as end_time",
                "k % 5 = 0 as full_scan",
                "concat('u', user_id % 5) as user_name",
                "app_name",
                "database_name",
                "concat('g', k % 9) as plan_gist",
                "k as rows_read",
                "k % 7 as rows_written",
                "case when k % 2 = 0 then 'normal' else 'high' end as priority",
                "k % 4 as retries",
                "array(k % 3, k % 5) as exec_node_ids",
                "array(k % 2) as kv_node_ids",
                "case when k % 5 = 1 then array('creation : CREATE INDEX ON t1 (a)') else cast(array() as array<string>) end"
                " as index_recommendations",
                "k % 2 = 0 as implicit_txn",
                "case when k % 9 > 0 then k * 1000 end as cpu_sql_nanos",
                "case when k % 8 = 0 then concat('tag=', k % 3) end as query_tags",
                "case when k % 4 > 0 then 'retry' end as last_retry_reason",
                "case when k % 6 > 0 then make_dt_interval(0, 0, 0, cents / 1000.0BD) end as contention",
                "case when event_type = 'error' then '40001' end as error_code",
                "case when event_type = 'error' then"
                " case when k % 2 = 0 then 'WriteTooOldError: x' else 'TransactionRetryError: x' end end"
                " as last_error_redactable",
            )
        )

    # -------------------------------------------------------------- statistics

    def stmt_stats(self, half_hour: bool = False) -> DataFrame:
        """Per-hour statistics; ``half_hour`` as they stood at the half hour."""
        events = self.events()
        if half_hour:
            events = events.where(F.minute("ts") < 30)
        agg = (
            events.selectExpr(
                "cast(date_trunc('hour', ts) as timestamp_ntz) as aggregated_ts",
                "user_id % 16 as t",
                "k % 4 as q",
                "k % 2 as p",
                "app_name",
                "cents",
                "k",
                "event_type",
            )
            .groupBy("aggregated_ts", "t", "q", "p", "app_name")
            .agg(
                F.count(F.lit(1)).alias("cnt"),
                F.sum("cents").alias("lat"),
                F.sum("k").alias("rr"),
                F.sum(F.expr("k % 7")).alias("rw"),
                F.count_if(F.col("event_type") == "error").alias("fails"),
                F.bool_or(F.expr("k % 5 = 0")).alias("fs"),
            )
        )
        mean = lambda c: f"cast(floor({c} / cnt) as bigint)"
        minutes = 30 if half_hour else 60
        return agg.selectExpr(
            "aggregated_ts",
            f"{hx('4096 + t * 4 + q')} as fingerprint_id",
            f"{hx('256 + t')} as transaction_fingerprint_id",
            f"{hx('p')} as plan_hash",
            "app_name",
            "concat('{\"db\": \"', case when t = 15 then 'system' else 'schedules' end, '\", \"fullScan\": ',"
            " case when fs then 'true' else 'false' end, ', \"query\": \"', case q when 0 then 'SELECT a FROM t0'"
            " when 1 then 'UPDATE t1 SET a = _' when 2 then 'INSERT INTO public.t2 VALUES (_)'"
            " else 'DELETE FROM schedules.public.t3' end, '\", \"querySummary\": \"stmt on t', q, '\"}') as metadata",
            f"concat('{{\"execution_statistics\": {{\"cnt\": ', cnt * 30, ', \"contentionTime\": {{\"mean\": ',"
            f" {mean('rw')}, '}}}}, \"statistics\": {{\"cnt\": ', cnt, ', \"failureCount\": ', fails,"
            f" ', \"runLat\": {{\"mean\": ', {mean('lat')}, '}}, \"svcLat\": {{\"mean\": ', {mean('lat * 2')},"
            f" '}}, \"rowsRead\": {{\"mean\": ', {mean('rr')}, '}}, \"rowsWritten\": {{\"mean\": ', {mean('rw')},"
            f" '}}}}}}') as statistics",
            "case when p = 1 then concat('{\"Name\": \"scan\", \"rows\": ', cnt, '}') end as sampled_plan",
            f"make_dt_interval(0, 0, {minutes}, 0) as aggregation_interval",
            "case q when 0 then array('creation : CREATE INDEX ON schedules.public.t0 (a)',"
            " 'creation : CREATE INDEX ON public.t0 (b)')"
            " when 1 then array('creation : CREATE INDEX ON t1 (a)') when 2 then array('no target named')"
            " else cast(array() as array<string>) end as index_recommendations",
        )

    def txn_stats(self, half_hour: bool = False) -> DataFrame:
        events = self.events()
        if half_hour:
            events = events.where(F.minute("ts") < 30)
        agg = (
            events.selectExpr(
                "cast(date_trunc('hour', ts) as timestamp_ntz) as aggregated_ts", "user_id % 16 as t", "app_name"
            )
            .groupBy("aggregated_ts", "t", "app_name")
            .agg(F.count(F.lit(1)).alias("cnt"))
        )
        ids = ", '\", \"', ".join(hx(f"4096 + t * 4 + {i}") for i in range(3))
        minutes = 30 if half_hour else 60
        return agg.selectExpr(
            "aggregated_ts",
            f"{hx('256 + t')} as fingerprint_id",
            "app_name",
            f"concat('{{\"stmtFingerprintIDs\": [\"', {ids}, '\"]}}') as metadata",
            "concat('{\"statistics\": {\"cnt\": ', cnt, '}}') as statistics",
            f"make_dt_interval(0, 0, {minutes}, 0) as aggregation_interval",
        )

    # ---------------------------------------------------- runs, state, metrics

    @cached_property
    def _runs(self) -> DataFrame:
        return self._derive_runs()

    @cached_property
    def _latest(self) -> datetime:
        return self.table("events").agg(F.max("ts")).first()[0]

    def runs(self) -> DataFrame:
        return self._runs

    def _derive_runs(self) -> DataFrame:
        """One test run per day of data, from 00:30 to 23:00."""
        days = self.table("events").select(F.to_date("ts").alias("d")).distinct()
        return (
            days.selectExpr(
                "concat('run_', date_format(d, 'yyyyMMdd')) as test_run",
                "case when day(d) % 10 = 0 then 'other' else 'schedules' end as database_name",
                "cast(d as timestamp_ntz) + interval 30 minutes as start_time",
                "cast(d as timestamp_ntz) + interval 23 hours as end_time",
                "make_dt_interval(0, 0, 70, 0) as agg_grace_interval",
            )
        )

    @cached_property
    def _state(self) -> DataFrame:
        return self._derive_state()

    def state(self) -> DataFrame:
        return self._state

    def _derive_state(self) -> DataFrame:
        """Watermarks: the latest event read per run and stream. Some runs have
        none yet, and some are read to the very end."""
        stream_of = F.array_compact(
            F.array(
                *[
                    F.when(F.col("event_type").isin(*events), F.lit(stream))
                    for stream, events in STREAM_EVENTS.items()
                ],
                F.lit("stmt_stats"),
                F.lit("txn_stats"),
            )
        )
        latest = (
            self.table("events")
            .select(F.to_date("ts").alias("d"), F.col("ts").cast("timestamp_ntz").alias("ts"), F.explode(stream_of).alias("stream"))
            .where("day(d) % 5 <> 1")
            .groupBy("d", "stream")
            .agg(F.max("ts").alias("ts"))
        )
        return (
            latest.selectExpr(
                "concat('run_', date_format(d, 'yyyyMMdd')) as test_run",
                "stream",
                "case when day(d) % 3 = 0 then cast(d as timestamp_ntz) + interval '1 00:10:00' day to second"
                " else ts end as watermark_ts",
                "ts + interval 5 seconds as updated_at",
            )
        )

    def metrics(self) -> DataFrame:
        """Ingest metrics as if each event were a micro-batch of its stream.

        One stream falls silent on the 21st of the month, one run on the 11th.
        """
        silent = "event_type not in ('error', 'click', 'view', 'purchase') and day(ts) > 20 or user_id % 4 = 3 and day(ts) > 10"
        return self.events().where(f"not ({silent})").selectExpr(
            "ts",
            "case when event_type in ('error', 'click') then 'contention' when event_type = 'view' then 'insights'"
            " when event_type = 'purchase' then 'stmt_stats' else 'txn_stats' end as stream",
            "concat('run_', user_id % 4) as test_run",
            "case when k % 3 = 0 then 0 else k end as rows",
            "case when k % 10 = 7 then 1 else 0 end as errors",
            "cents as duration_ms",
            "cast(k * 3 as double) as lag_seconds",
            "case when event_type = 'click' and event_id % 10 = 0 then 1 else 0 end as backfilled",
        )

    def exceptions(self) -> DataFrame:
        """One retry error per failed event, half of them with the conflicting transaction."""
        kind = (
            "case when event_id % 7 = 0 then 'ReadWithinUncertaintyIntervalError'"
            " when k % 2 = 0 then 'WriteTooOldError' else 'TransactionRetryError' end"
        )
        prefix = f"substring({_txn_id('event_id')}, 1, 8)"
        key = "concat('/Table/', 100 + k % 5, '/1/\\\\\"', user_id, '\\\\\"/0')"
        epoch = "cast(floor(unix_micros(cast(ts as timestamp)) / 1000000) as bigint)"
        conflict = (
            f"case when event_id % 2 = 0 then concat(' conflicting txn: meta={{id=', {prefix}, ' key=', {key},"
            f" ' iso=Serializable ts=', {epoch}, '.000000000,1 seq=1}}') else '' end"
        )
        return (
            self.events()
            .where("event_type = 'error'")
            .selectExpr(
                "event_id as exception_id",
                "concat('Error occurred: restart transaction: TransactionRetryWithProtoRefreshError: ',"
                f" {kind}, ': write for key too old', {conflict}, ': \"sql txn\" meta={{id=', {prefix}, ' seq=1}} lock=true')"
                " as exception_str",
                "concat('run_', date_format(ts, 'yyyyMMdd')) as test_run",
                "case when event_id % 4 < 3 then cast(null as string) else app_name end as app_name",
                "case when event_id % 5 = 0 then 'public' end as schema_name",
                "case event_id % 3 when 0 then 'same_app' when 1 then 'diff_app' else 'any_app' end as option",
            )
        )

    # -------------------------------------------------- tables as they are kept

    def persisted(self) -> dict[str, DataFrame]:
        """The tables after ingesting every run from its start to its end."""
        slices = whole_run_slices(self.runs())
        tagged = ingest.visible_insights(self.insights(), slices)
        return {
            "contention": ingest.new_contention(self.contention(), slices),
            "insights": ingest.new_insights(tagged, None),
            "txn_id_map": ingest.new_txn_ids(tagged, None),
            "stmt_stats": ingest.tag_with_runs(self.stmt_stats(), slices, "stmt_stats"),
            "txn_stats": ingest.tag_with_runs(self.txn_stats(), slices, "txn_stats"),
        }

    def stored(self) -> dict[str, DataFrame]:
        """The same tables written out, as the root-cause jobs find them."""
        return materialise_all(self.persisted(), shared_folder(self.spark))

    # ------------------------------------------------------------ catalog tables

    def catalog(self) -> dict[str, DataFrame]:
        """Tables t0 to t3 in two schemas, their indexes, and the reads counted
        from the events on each table."""
        events = self.events().selectExpr("k % 4 as t", "k % 3 as i", "ts").groupBy("t", "i").agg(
            F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_read")
        )
        tables = events.select("t").distinct().selectExpr(
            "t", "explode(array('public', 'archive')) as schema_name"
        ).selectExpr(
            "case when schema_name = 'public' then 100 + t else 200 + t end as table_id",
            "'schedules' as database_name",
            "schema_name",
            "concat('t', t) as name",
        )
        indexes = events.selectExpr("100 + t as descriptor_id", "i + 1 as index_id", "concat('idx_', i) as index_name").unionByName(
            events.where("i = 0").selectExpr("200 + t as descriptor_id", "i + 1 as index_id", "concat('idx_', i) as index_name")
        )
        usage = events.where("i <> 2").selectExpr(
            "100 + t as table_id", "i + 1 as index_id", "n as total_reads", "last_read"
        )
        return {"tables": tables, "table_indexes": indexes, "index_usage_statistics": usage}

    def capacities(self) -> DataFrame:
        return self.spark.createDataFrame(
            [
                ("cluster_statement_statistics", 3000),
                ("cluster_transaction_statistics", 3000),
                ("cluster_execution_insights", 1000),
                ("transaction_contention_events", 100000),
            ],
            "source string, capacity bigint",
        )
