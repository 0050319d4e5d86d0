"""Readers for the observability tables: files (batch and stream) and JDBC."""

from __future__ import annotations

import os
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens import schemas as S
from runlens.functions.values import hex_text, instant


def normalise(df: DataFrame, stream: str) -> DataFrame:
    """Columns by name, in schema order, fingerprints as lower-case hex text."""
    columns = []
    for field in S.STREAM_SCHEMAS[stream].fields:
        col = F.col(field.name)
        if field.name in S.FINGERPRINTS[stream]:
            col = hex_text(col, df.schema[field.name].dataType)
        columns.append(col.alias(field.name))
    return df.select(*columns)


def binary_fingerprints(df: DataFrame, stream: str) -> DataFrame:
    """The storage form of fingerprints: 8 bytes in place of hex text."""
    return df.withColumns(
        {c: F.unhex(c) for c in S.FINGERPRINTS[stream] if isinstance(df.schema[c].dataType, T.StringType)}
    )


def file_schema(stream: str, binary: bool = True) -> T.StructType:
    """The declared schema of a source; ``binary`` for fingerprints kept as bytes."""
    return T.StructType(
        [
            T.StructField(f.name, T.BinaryType() if binary and f.name in S.FINGERPRINTS[stream] else f.dataType)
            for f in S.STREAM_SCHEMAS[stream].fields
        ]
    )


def _check(stream: str) -> None:
    if stream not in S.ALL_STREAMS:
        raise ValueError(f"unknown stream {stream!r}; one of {', '.join(S.ALL_STREAMS)}")


def read_stream_table(
    spark: SparkSession,
    stream: str,
    path: str,
    since: datetime | None = None,
    until: datetime | None = None,
    database: str | None = None,
    fmt: str = "parquet",
    binary: bool = True,
) -> DataFrame:
    """One of the four sources as a batch, cut to ``[since, until)`` at the scan.

    The statistics sources have no database column and are never filtered by it.
    """
    _check(stream)
    df = spark.read.format(fmt).schema(file_schema(stream, binary)).load(path)
    ts = F.col(S.EVENT_TIME[stream])
    if since is not None:
        df = df.where(ts >= instant(since))
    if until is not None:
        df = df.where(ts < instant(until))
    if database is not None and stream in S.LIVE_STREAMS:
        df = df.where(F.col("database_name") == database)
    if stream == "insights":
        df = df.where(F.col("query") != S.HIDDEN_QUERY)
    return normalise(df, stream)


def stream_table(
    spark: SparkSession,
    stream: str,
    path: str,
    fmt: str = "parquet",
    max_files: int | None = None,
    binary: bool = True,
) -> DataFrame:
    """The same source as a streaming DataFrame over arriving files."""
    _check(stream)
    reader = spark.readStream.format(fmt).schema(file_schema(stream, binary))
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return normalise(reader.load(path), stream)


def read_catalog_table(spark: SparkSession, name: str, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).schema(S.CATALOG_SCHEMAS[name]).load(path)


def row_estimate(estimates: DataFrame, table_name: str) -> int | None:
    """The stored row estimate of one table."""
    row = estimates.where(F.col("table_name") == table_name).select("estimated_row_count").first()
    return None if row is None else row["estimated_row_count"]


def jdbc_options(
    table: str,
    url: str | None = None,
    host: str | None = None,
    port: int = 26257,
    database: str | None = None,
    user: str | None = None,
    password: str | None = None,
    driver: str = "org.postgresql.Driver",
    time_column: str | None = None,
    lower: datetime | None = None,
    upper: datetime | None = None,
    partitions: int = 16,
    fetch_size: int = 10_000,
) -> dict[str, str]:
    """Options for ``spark.read.format("jdbc")``: a full URL, or its parts.

    Without either, the URL is taken from ``DATABASE_URL``. With a time column
    and bounds the read is split into ranges, one per task.
    """
    target = url or (None if host else os.environ.get("DATABASE_URL"))
    if target is None:
        if not host or not database:
            raise ValueError("give a url, host and database, or set DATABASE_URL")
        target = f"jdbc:postgresql://{host}:{port}/{database}"
    if not target.startswith("jdbc:"):
        target = "jdbc:" + target
    options = {"url": target, "dbtable": table, "driver": driver, "fetchsize": str(fetch_size)}
    if user:
        options["user"] = user
    if password:
        options["password"] = password
    if time_column and lower and upper:
        options.update(
            partitionColumn=time_column,
            lowerBound=lower.isoformat(sep=" "),
            upperBound=upper.isoformat(sep=" "),
            numPartitions=str(partitions),
        )
    return options


def read_jdbc(spark: SparkSession, stream: str, **options) -> DataFrame:
    """A source table over JDBC; time and database filters are pushed to it."""
    _check(stream)
    if "lower" in options and "time_column" not in options:
        options["time_column"] = S.EVENT_TIME[stream]
    return normalise(spark.read.format("jdbc").options(**jdbc_options(**options)).load(), stream)


def write_jdbc(df: DataFrame, table: str, batch_size: int = 1000, mode: str = "append", **options) -> None:
    """Append to a database table in batches of ``batch_size`` rows per statement."""
    opts = jdbc_options(table, **options)
    opts.pop("fetchsize")
    df.write.format("jdbc").options(**opts, batchsize=str(batch_size)).mode(mode).save()
