"""Column expressions shared by the plans: time, fingerprints, intervals, JSON."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens import schemas as S


def instant(now: datetime | Column | None) -> Column:
    """A point in time as a literal, so that filters on it reach the scan."""
    if now is None:
        return F.current_timestamp()
    if isinstance(now, Column):
        return now
    if now.tzinfo is None:
        return F.lit(now.isoformat(sep=" ")).cast("timestamp_ntz")
    return F.lit(now.isoformat(sep=" ")).cast("timestamp")


def seconds(n: int | float) -> Column:
    return F.expr(f"make_dt_interval(0, 0, 0, {n})")


def hours(n: int) -> Column:
    return F.expr(f"make_dt_interval(0, {n}, 0, 0)")


def days(n: int) -> Column:
    return F.expr(f"make_dt_interval({n}, 0, 0, 0)")


def truncated(unit: str, ts: Column, dtype: T.DataType) -> Column:
    """``date_trunc`` that keeps the column's own timestamp type."""
    return F.date_trunc(unit, ts).cast(dtype)


def interval_micros(interval: Column) -> Column:
    """Whole microseconds of a day-time interval."""
    return (interval.cast("decimal(20,6)") * F.lit(1000000)).cast("bigint")


def interval_ms(interval: Column) -> Column:
    return F.round(interval.cast("decimal(20,6)") * F.lit(1000), 2).cast("double")


def hex_text(col: Column, dtype: T.DataType) -> Column:
    """Lower-case hex of a fingerprint, whichever way it is stored."""
    return F.lower(F.hex(col)) if isinstance(dtype, T.BinaryType) else F.lower(col)


def is_placeholder(fp: Column) -> Column:
    return fp == F.lit(S.ZERO_FINGERPRINT)


def is_known(fp: Column) -> Column:
    """Neither missing nor the all-zero placeholder."""
    return fp.isNotNull() & (fp != F.lit(S.ZERO_FINGERPRINT))


def exact_sum(c: str | Column) -> Column:
    """A sum of doubles that does not depend on their order: added as decimals, and a decimal itself."""
    column = F.col(c) if isinstance(c, str) else c
    return F.sum(column.cast("decimal(28,9)"))


def statement_metadata(col: str | Column = "metadata") -> Column:
    return F.from_json(col, S.STATEMENT_METADATA)


def transaction_metadata(col: str | Column = "metadata") -> Column:
    return F.from_json(col, S.TRANSACTION_METADATA)


def statistics(col: str | Column = "statistics") -> Column:
    return F.from_json(col, S.STATISTICS)


def metadata_of(df: DataFrame, transactions: bool = False) -> Column:
    """The metadata of statistics rows: the typed column ``m`` where the table has it, else the parsed document."""
    if "m" in df.columns:
        return F.col("m")
    return transaction_metadata() if transactions else statement_metadata()


def statistics_of(df: DataFrame) -> Column:
    """The figures of statistics rows: the typed column ``s`` where the table has it, else the parsed document."""
    return F.col("s") if "s" in df.columns else statistics()


def typed_statistics(df: DataFrame, stream: str) -> DataFrame:
    """Statistics rows with their documents as typed columns ``m`` and ``s``, parsed once.

    Written as Parquet, each figure is a column of its own: reports read the ones they use, and
    filters on them reach the files.
    """
    transactions = stream == "txn_stats"
    return df.withColumns({"m": metadata_of(df, transactions), "s": statistics_of(df)})


def same(a: Column, b: Column) -> Column:
    """Equality with NULL never matching, as one boolean without NULL."""
    return F.coalesce(a == b, F.lit(False))
