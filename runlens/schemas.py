"""Table schemas, keys, retention rules and the JSON paths that are read."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------- fixed values
ZERO_FINGERPRINT = "0000000000000000"
NO_ERROR = "<<NULL>>"
INTERNAL_APPS = "$ internal%"
SYSTEM_DATABASES = ("system", "crdb_internal")
HIDDEN_QUERY = "SELECT _"
RETENTION_DAYS = 90
DEFAULT_GRACE_MINUTES = 70
LIVE_STREAMS = ("contention", "insights")
AGG_STREAMS = ("stmt_stats", "txn_stats")
ALL_STREAMS = LIVE_STREAMS + AGG_STREAMS
SOURCE_NAMES = {
    "stmt_stats": "cluster_statement_statistics",
    "txn_stats": "cluster_transaction_statistics",
    "insights": "cluster_execution_insights",
    "contention": "transaction_contention_events",
}
# ------------------------------------------------------------ end fixed values


_TYPES = {
    "STRING": T.StringType(),
    "BIGINT": T.LongType(),
    "DOUBLE": T.DoubleType(),
    "BOOLEAN": T.BooleanType(),
    "BINARY": T.BinaryType(),
    "TIMESTAMP": T.TimestampType(),
    "TIMESTAMP_NTZ": T.TimestampNTZType(),
    "INTERVAL DAY TO SECOND": T.DayTimeIntervalType(),
    "ARRAY<STRING>": T.ArrayType(T.StringType()),
    "ARRAY<BIGINT>": T.ArrayType(T.LongType()),
}


def flat_schema(columns: str) -> T.StructType:
    """A schema from ``name TYPE, name TYPE``; needs no session, unlike DDL text."""
    pairs = (column.strip().split(" ", 1) for column in columns.split(","))
    return T.StructType([T.StructField(name, _TYPES[dtype]) for name, dtype in pairs])


RUNS = flat_schema(
    "test_run STRING, database_name STRING, start_time TIMESTAMP, end_time TIMESTAMP, "
    "agg_grace_interval INTERVAL DAY TO SECOND"
)

INGEST_STATE = flat_schema("test_run STRING, stream STRING, watermark_ts TIMESTAMP, updated_at TIMESTAMP")

CONTENTION = flat_schema(
    "collection_ts TIMESTAMP, blocking_txn_id STRING, blocking_txn_fingerprint_id STRING, "
    "waiting_txn_id STRING, waiting_txn_fingerprint_id STRING, "
    "contention_duration INTERVAL DAY TO SECOND, contending_key BINARY, contending_pretty_key STRING, "
    "waiting_stmt_id STRING, waiting_stmt_fingerprint_id STRING, database_name STRING, "
    "schema_name STRING, table_name STRING, index_name STRING, contention_type STRING"
)

INSIGHTS = flat_schema(
    "session_id STRING, txn_id STRING, txn_fingerprint_id STRING, stmt_id STRING, "
    "stmt_fingerprint_id STRING, problem STRING, causes ARRAY<STRING>, query STRING, status STRING, "
    "start_time TIMESTAMP_NTZ, end_time TIMESTAMP_NTZ, full_scan BOOLEAN, user_name STRING, "
    "app_name STRING, database_name STRING, plan_gist STRING, rows_read BIGINT, rows_written BIGINT, "
    "priority STRING, retries BIGINT, last_retry_reason STRING, exec_node_ids ARRAY<BIGINT>, "
    "kv_node_ids ARRAY<BIGINT>, contention INTERVAL DAY TO SECOND, index_recommendations ARRAY<STRING>, "
    "implicit_txn BOOLEAN, cpu_sql_nanos BIGINT, error_code STRING, last_error_redactable STRING, "
    "query_tags STRING"
)

TXN_STATS = flat_schema(
    "aggregated_ts TIMESTAMP, fingerprint_id STRING, app_name STRING, metadata STRING, "
    "statistics STRING, aggregation_interval INTERVAL DAY TO SECOND"
)

STMT_STATS = flat_schema(
    "aggregated_ts TIMESTAMP, fingerprint_id STRING, transaction_fingerprint_id STRING, "
    "plan_hash STRING, app_name STRING, metadata STRING, statistics STRING, sampled_plan STRING, "
    "aggregation_interval INTERVAL DAY TO SECOND, index_recommendations ARRAY<STRING>"
)

TXN_ID_MAP = flat_schema("txn_id STRING, txn_fingerprint_id STRING")

# Source tables by stream; the persisted form of each adds ``test_run``.
STREAM_SCHEMAS = {
    "contention": CONTENTION,
    "insights": INSIGHTS,
    "stmt_stats": STMT_STATS,
    "txn_stats": TXN_STATS,
}

CATALOG_SCHEMAS = {
    "tables": flat_schema("table_id BIGINT, database_name STRING, schema_name STRING, name STRING"),
    "table_indexes": flat_schema("descriptor_id BIGINT, index_id BIGINT, index_name STRING"),
    "index_usage_statistics": flat_schema(
        "table_id BIGINT, index_id BIGINT, total_reads BIGINT, last_read TIMESTAMP"
    ),
    "table_row_statistics": flat_schema("table_name STRING, estimated_row_count BIGINT"),
}

EVENT_TIME = {
    "contention": "collection_ts",
    "insights": "start_time",
    "stmt_stats": "aggregated_ts",
    "txn_stats": "aggregated_ts",
}

# Uniqueness of the persisted tables. The insight key folds a missing error
# text to NO_ERROR, see plans.ingest.insight_keys.
KEYS = {
    "runs": ("test_run",),
    "ingest_state": ("test_run", "stream"),
    "insights": (
        "test_run",
        "txn_fingerprint_id",
        "stmt_fingerprint_id",
        "status",
        "app_name",
        "last_error_redactable",
    ),
    "txn_id_map": ("test_run", "txn_id"),
    "txn_stats": ("test_run", "aggregated_ts", "fingerprint_id", "app_name"),
    "stmt_stats": (
        "test_run",
        "aggregated_ts",
        "fingerprint_id",
        "transaction_fingerprint_id",
        "plan_hash",
        "app_name",
    ),
}

# Columns that a repeated key overwrites; all others keep the first row's value.
UPDATED_COLUMNS = {
    "stmt_stats": ("metadata", "statistics", "sampled_plan", "index_recommendations"),
    "txn_stats": ("metadata", "statistics"),
}

# The column whose age decides retention; txn_id_map has none and goes only
# when its run is deleted.
TTL_COLUMN = {
    "runs": "end_time",
    "ingest_state": "updated_at",
    "contention": "collection_ts",
    "insights": "start_time",
    "txn_stats": "aggregated_ts",
    "stmt_stats": "aggregated_ts",
    "caller_contention_results": "aggregated_ts",
    "caller_failed_statement": "collection_ts",
}

# Tables removed with their run; ingest_state is not among them.
RUN_CHILDREN = (
    "contention",
    "insights",
    "txn_id_map",
    "txn_stats",
    "stmt_stats",
    "caller_contention_results",
)

NULLABLE = {
    "contention": ("index_name",),
    "insights": (
        "last_retry_reason",
        "contention",
        "cpu_sql_nanos",
        "error_code",
        "last_error_redactable",
        "query_tags",
    ),
    "stmt_stats": (),
    "txn_stats": (),
}

FINGERPRINTS = {
    "contention": (
        "blocking_txn_fingerprint_id",
        "waiting_txn_fingerprint_id",
        "waiting_stmt_fingerprint_id",
    ),
    "insights": ("txn_fingerprint_id", "stmt_fingerprint_id"),
    "stmt_stats": ("fingerprint_id", "transaction_fingerprint_id", "plan_hash"),
    "txn_stats": ("fingerprint_id",),
    "txn_id_map": ("txn_fingerprint_id",),
}

# Partial schemas of the JSON documents. Numbers are read as DOUBLE since the
# writers also use the form 4E+1 for whole numbers.
STATEMENT_METADATA = "query STRING, querySummary STRING, db STRING, fullScan BOOLEAN"
TRANSACTION_METADATA = "stmtFingerprintIDs ARRAY<STRING>"
STATISTICS = (
    "statistics STRUCT<cnt: DOUBLE, failureCount: DOUBLE, runLat: STRUCT<mean: DOUBLE>, "
    "svcLat: STRUCT<mean: DOUBLE>, rowsRead: STRUCT<mean: DOUBLE>, rowsWritten: STRUCT<mean: DOUBLE>>, "
    "execution_statistics STRUCT<cnt: DOUBLE, contentionTime: STRUCT<mean: DOUBLE>>"
)

EXCEPTIONS = flat_schema(
    "exception_id BIGINT, exception_str STRING, test_run STRING, app_name STRING, "
    "schema_name STRING, option STRING"
)
