"""Retention and integrity rules of the persisted tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens import schemas as S
from runlens.functions.values import days, instant
from runlens.plans.ingest import insight_keys


def unexpired(
    df: DataFrame, table: str, now: datetime | Column | None = None, keep_days: int = S.RETENTION_DAYS
) -> DataFrame:
    """Rows that are still within their retention time.

    The bare time column is compared, so the filter reaches the scan.
    """
    column = S.TTL_COLUMN.get(table)
    if column is None:
        return df
    return df.where(F.col(column) > instant(now) - days(keep_days))


def without_runs(tables: dict[str, DataFrame], deleted: DataFrame) -> dict[str, DataFrame]:
    """All tables after deleting runs: the registry and the tables that follow it."""
    gone = deleted.select("test_run").distinct()
    return {
        name: df.join(gone, "test_run", "left_anti") if name == "runs" or name in S.RUN_CHILDREN else df
        for name, df in tables.items()
    }


def orphans(child: DataFrame, runs: DataFrame) -> DataFrame:
    """Rows whose run is not registered."""
    return child.join(runs.select("test_run"), "test_run", "left_anti")


def duplicate_keys(df: DataFrame, table: str) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    keys = insight_keys() if table == "insights" else {k: F.col(k) for k in S.KEYS[table]}
    return (
        df.groupBy(*[e.alias(k) for k, e in keys.items()])
        .agg(F.count(F.lit(1)).alias("rows"))
        .where("rows > 1")
    )


def null_counts(df: DataFrame, required: tuple[str, ...] | None = None) -> DataFrame:
    """NULLs per required column, as rows (column_name, nulls), from one pass."""
    columns = required or tuple(df.columns)
    counted = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counted.unpivot([], list(columns), "column_name", "nulls")


def required_columns(stream: str) -> tuple[str, ...]:
    return tuple(c for c in S.STREAM_SCHEMAS[stream].names if c not in S.NULLABLE[stream])


def empty_tables(spark) -> dict[str, DataFrame]:
    """Every table without rows: writing them with ``overwrite`` resets a store."""
    out = {
        "runs": spark.createDataFrame([], S.RUNS),
        "ingest_state": spark.createDataFrame([], S.INGEST_STATE),
    }
    tagged = {**S.STREAM_SCHEMAS, "txn_id_map": S.TXN_ID_MAP}
    for name, schema in tagged.items():
        full = S.flat_schema("test_run STRING")
        for f in schema.fields:
            full = full.add(f)
        out[name] = spark.createDataFrame([], full)
    return out
