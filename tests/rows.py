"""Small hand-made rows in the shapes of the source tables."""

from __future__ import annotations

import json
from datetime import datetime, timedelta, timezone

from pyspark.sql import types as T

from runlens import schemas as S

T0 = datetime(2025, 6, 1, 10, 0, 0, tzinfo=timezone.utc)
Z = S.ZERO_FINGERPRINT


def at(seconds: float) -> datetime:
    return T0 + timedelta(seconds=seconds)


def fp(n: int) -> str:
    return f"{n:016x}"


def frame(spark, schema: T.StructType, rows: list[dict], run: bool = False):
    """Rows with the given values, NULL elsewhere; ``run`` adds test_run in front."""
    if run:
        schema = T.StructType([T.StructField("test_run", T.StringType()), *schema.fields])
    fixed = []
    for r in rows:
        values = []
        for f in schema.fields:
            v = r.get(f.name)
            if isinstance(f.dataType, T.TimestampNTZType) and v is not None:
                v = v.replace(tzinfo=None)
            values.append(v)
        unknown = set(r) - set(schema.names)
        assert not unknown, unknown
        fixed.append(tuple(values))
    return spark.createDataFrame(fixed, schema)


def contention(spark, rows, **kw):
    base = dict(
        collection_ts=at(1), blocking_txn_id="b", blocking_txn_fingerprint_id=fp(1), waiting_txn_id="w",
        waiting_txn_fingerprint_id=fp(2), contention_duration=timedelta(milliseconds=5), contending_pretty_key="/k",
        waiting_stmt_id="s", waiting_stmt_fingerprint_id=fp(3), database_name="db", schema_name="public",
        table_name="t", contention_type="LOCK_WAIT",
    )
    return frame(spark, S.CONTENTION, [{**base, **r} for r in rows], **kw)


def insights(spark, rows, **kw):
    base = dict(
        session_id="s", txn_id="t1", txn_fingerprint_id=fp(2), stmt_id="s1", stmt_fingerprint_id=fp(3),
        problem="SlowExecution", causes=[], query="UPDATE t SET a = _", status="Completed", start_time=at(1),
        end_time=at(2), full_scan=False, app_name="app", database_name="db", rows_read=1, rows_written=1, retries=0,
    )
    return frame(spark, S.INSIGHTS, [{**base, **r} for r in rows], **kw)


def statement_doc(cnt=10, run=0.01, svc=0.02, read=1.0, written=0.0, fails=0, sampled=5, contention=0.0):
    return json.dumps(
        {
            "execution_statistics": {"cnt": sampled, "contentionTime": {"mean": contention}},
            "statistics": {
                "cnt": cnt, "failureCount": fails, "runLat": {"mean": run}, "svcLat": {"mean": svc},
                "rowsRead": {"mean": read}, "rowsWritten": {"mean": written},
            },
        }
    )


def stmt_stats(spark, rows, **kw):
    base = dict(
        aggregated_ts=at(0), fingerprint_id=fp(3), transaction_fingerprint_id=fp(2), plan_hash=fp(0), app_name="app",
        metadata=json.dumps({"db": "db", "query": "SELECT 1", "querySummary": "SELECT 1", "fullScan": False}),
        statistics=statement_doc(), aggregation_interval=timedelta(hours=1), index_recommendations=[],
    )
    return frame(spark, S.STMT_STATS, [{**base, **r} for r in rows], **kw)


def txn_stats(spark, rows, **kw):
    base = dict(
        aggregated_ts=at(0), fingerprint_id=fp(2), app_name="app",
        metadata=json.dumps({"stmtFingerprintIDs": [fp(3), fp(4)]}),
        statistics=json.dumps({"statistics": {"cnt": 10}}), aggregation_interval=timedelta(hours=1),
    )
    return frame(spark, S.TXN_STATS, [{**base, **r} for r in rows], **kw)


def runs(spark, *names, start=0, end=3600, database="db"):
    rows = [(n, database, at(start), at(end), timedelta(minutes=70)) for n in names]
    return spark.createDataFrame(rows, S.RUNS)


def rows_of(df, *columns):
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)
