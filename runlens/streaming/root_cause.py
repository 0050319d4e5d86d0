"""The first stage of the root-cause search while errors and contention events arrive.

Both streams are joined on run and key within the time that the stage allows, so Spark keeps events only for as long as an error of
the past minute may still ask for them. An error's answer is the earliest event; it is given once the
watermark says that no earlier one can come.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.plans.root_cause import CONFLICT_WINDOW_SECONDS, parse_exceptions, with_application

#: What orders the events of an error, then what the answer takes from the first.
FIRST = ("collection_ts", "waiting_txn_id", "blocking_txn_id")
TAKEN = (
    "blocking_txn_fingerprint_id",
    "waiting_txn_fingerprint_id",
    "waiting_stmt_fingerprint_id",
    "database_name",
    "schema_name",
    "table_name",
    "index_name",
    "contention_type",
)


def by_contention_event(errors: DataFrame, contention: DataFrame, insights: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Stage 1 for streams of errors (as in ``schemas.EXCEPTIONS``) and of contention events tagged with their run.

    ``insights`` is a table. ``delay`` is how late either stream may be; later rows do not take part. The columns
    are those of ``plans.root_cause.by_contention_event``, and so are the rows once both streams have passed.
    """
    asked = (
        parse_exceptions(errors)
        .where("txn_id_prefix IS NOT NULL AND contention_key IS NOT NULL AND conflict_ts IS NOT NULL")
        .withWatermark("conflict_ts", delay)
        .select(
            "exception_id",
            F.col("test_run").alias("in_run"),
            "contention_key",
            "txn_id_prefix",
            "conflict_ts",
            F.col("app_name").alias("in_app"),
            F.col("schema_name").alias("in_schema"),
        )
    )
    events = contention.withWatermark("collection_ts", delay).select("test_run", "contending_pretty_key", *FIRST, *TAKEN)
    span = F.expr(f"INTERVAL {CONFLICT_WINDOW_SECONDS} SECONDS")
    met = events.join(
        asked,
        (F.col("test_run") == F.col("in_run"))
        & (F.col("contending_pretty_key") == F.col("contention_key"))
        & (F.col("collection_ts") >= F.col("conflict_ts"))
        & (F.col("collection_ts") <= F.col("conflict_ts") + span)
        & F.lower("waiting_txn_id").startswith(F.col("txn_id_prefix"))
        & (F.col("in_schema").isNull() | (F.col("schema_name") == F.col("in_schema"))),
    )
    # one event time goes on, that of the error; the event's becomes a plain value
    plain = met.select(
        "exception_id", "test_run", "in_app", "conflict_ts",
        F.struct(F.timestamp_micros(F.unix_micros("collection_ts")).alias("collection_ts"), *FIRST[1:], *TAKEN).alias("event"),
    )
    first = plain.groupBy("exception_id", "test_run", "in_app", "conflict_ts").agg(F.min("event").alias("event"))
    return with_application(first.select("exception_id", "test_run", "in_app", "event.*"), insights)
