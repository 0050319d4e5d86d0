"""Index opportunities: recommendations scored by the workload they touch."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions import patterns as P
from runlens.functions.values import exact_sum, metadata_of, statistics_of
from runlens.plans.reports import Now, recent


@dataclass(frozen=True)
class Weights:
    """Tunable parameters of the report."""

    lookback_hours: int = 24
    min_executions: int = 50
    latency: str = "0.5"
    contention: str = "0.3"
    rows_read: str = "0.1"
    retry: str = "0.1"


def recommended(stats: DataFrame, now: Now = None, weights: Weights = Weights()) -> DataFrame:
    """One row per recommendation of a statement that was sampled often enough.

    Recommendations that name no table drop out. The path is read from its
    end: table, schema, database, as far as there are parts.
    """
    sampled = F.col("s.execution_statistics.cnt").cast("bigint")
    path = F.col("full_path")
    return (
        recent(stats, "aggregated_ts", now, weights.lookback_hours)
        .where(F.size("index_recommendations") > 0)
        .withColumns({"m": metadata_of(stats), "s": statistics_of(stats)})
        .where(sampled >= weights.min_executions)
        .select(
            "fingerprint_id",
            "app_name",
            F.col("m.query").alias("query"),
            F.col("m.fullScan").alias("full_scan"),
            sampled.alias("execution_count"),
            F.col("s.statistics.svcLat.mean").alias("avg_latency_sec"),
            F.col("s.execution_statistics.contentionTime.mean").alias("avg_contention_sec"),
            F.col("s.statistics.rowsRead.mean").alias("avg_rows_read"),
            F.col("s.statistics.rowsWritten.mean").alias("avg_rows_written"),
            F.explode("index_recommendations").alias("index_recommendation"),
        )
        .withColumn("full_path", P.first_group(F.col("index_recommendation"), P.INDEX_TARGET))
        .where(path.isNotNull())
        .withColumns(
            {
                "database_name": P.name_part(path, 3),
                "schema_name": P.name_part(path, 2),
                "table_name": P.name_part(path, 1),
            }
        )
    )


TARGET = ["database_name", "schema_name", "table_name", "full_path", "index_recommendation"]


def scored(recs: DataFrame) -> DataFrame:
    """Totals of a recommendation row: executions times each mean."""
    n = F.col("execution_count").cast("double")
    return recs.withColumns(
        {
            "total_latency_sec": n * F.col("avg_latency_sec"),
            "total_contention_sec": n * F.col("avg_contention_sec"),
            "total_rows_read": n * F.col("avg_rows_read"),
            "total_rows_written": n * F.col("avg_rows_written"),
        }
    )


def aggregated(recs: DataFrame) -> DataFrame:
    """Totals and the statements, applications and texts behind each recommendation.

    Summed per statement, application and text first: a recommendation that
    most rows carry is spread over them, and only their distinct values meet
    in its final row.
    """
    sums = ["total_latency_sec", "total_contention_sec", "total_rows_read", "total_rows_written"]
    parts = scored(recs).groupBy(
        *TARGET, "fingerprint_id", "app_name", F.substring("query", 1, 200).alias("sample")
    ).agg(
        F.sum("execution_count").alias("total_executions"),
        *[exact_sum(c).alias(c) for c in sums],
        F.bool_or("full_scan").alias("involves_full_scan"),
    )
    distinct = lambda c, name: F.array_sort(F.collect_set(c)).alias(name)
    out = parts.groupBy(*TARGET).agg(
        F.sum("total_executions").cast("double").alias("total_executions"),
        *[F.sum(c).cast("double").alias(c) for c in sums],
        F.bool_or("involves_full_scan").alias("involves_full_scan"),
        distinct("fingerprint_id", "related_fingerprints"),
        distinct("app_name", "related_applications"),
        distinct("sample", "sample_queries"),
    )
    per_execution = lambda c: F.try_divide(F.col(c), F.nullif("total_executions", F.lit(0.0)))
    return out.withColumns(
        {
            "weighted_avg_latency_sec": per_execution("total_latency_sec"),
            "weighted_avg_contention_sec": per_execution("total_contention_sec"),
        }
    )


def existing_indexes(tables: DataFrame, indexes: DataFrame, usage: DataFrame) -> DataFrame:
    """Indexes of each table with their usage, NULL where never used.

    The three are catalog tables; the planner broadcasts them while their
    files are below its size limit and shuffles by table id beyond it.
    """
    ti = indexes.select(F.col("descriptor_id").alias("table_id"), "index_id", "index_name")
    return (
        tables.withColumnRenamed("name", "table_name")
        .join(ti, "table_id")
        .join(usage, ["table_id", "index_id"], "left")
        .select("database_name", "schema_name", "table_name", "index_name", "index_id", "total_reads", "last_read")
    )


def index_usage(existing: DataFrame) -> DataFrame:
    """The indexes of a table as one JSON array, most read first; times as text with microseconds."""
    reads = F.coalesce("total_reads", F.lit(0))
    entry = F.struct(
        (-reads).alias("_order"),
        F.col("index_name").alias("index_name"),
        F.col("index_id").alias("index_id"),
        reads.alias("total_reads"),
        F.date_format("last_read", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("last_read"),
    )
    bare = lambda e: F.struct(*[e[c].alias(c) for c in ("index_name", "index_id", "total_reads", "last_read")])
    return existing.groupBy("database_name", "schema_name", "table_name").agg(
        F.to_json(
            F.transform(F.sort_array(F.collect_list(entry)), bare), {"ignoreNullFields": "false"}
        ).alias("existing_index_usage")
    )


def workload_profile(written: Column, read: Column) -> Column:
    return F.when(written > read, "WRITE_HEAVY").when(read > written, "READ_HEAVY").otherwise("BALANCED")


def impact_score(weights: Weights = Weights()) -> Column:
    """Weighted sum of the totals in decimals; contention also counts at half
    its value with the retry weight."""
    dec = lambda c: c.cast("decimal(28,9)")
    weight = lambda w: F.lit(w).cast("decimal(6,3)")
    contention = F.col("total_contention_sec")
    return (
        dec(F.col("total_latency_sec")) * weight(weights.latency)
        + dec(contention) * weight(weights.contention)
        + dec(F.col("total_rows_read") / 1000000.0) * weight(weights.rows_read)
        + dec(contention * 0.5) * weight(weights.retry)
    )


def index_opportunities(
    stats: DataFrame,
    tables: DataFrame,
    indexes: DataFrame,
    usage: DataFrame,
    now: Now = None,
    weights: Weights = Weights(),
) -> DataFrame:
    """The whole report, highest impact first.

    An index list belongs to a recommendation if the table names agree, and
    the schema and database too as far as the recommendation names them.
    """
    a = aggregated(recommended(stats, now, weights)).alias("a")
    ip = index_usage(existing_indexes(tables, indexes, usage)).alias("ip")
    known = lambda c: F.col(f"a.{c}").isNull() | (F.col(f"a.{c}") == F.col(f"ip.{c}"))
    joined = a.join(
        ip,
        (F.col("a.table_name") == F.col("ip.table_name")) & known("schema_name") & known("database_name"),
        "left",
    ).select("a.*", "ip.existing_index_usage")
    return joined.select(
        *TARGET,
        "total_executions",
        "total_latency_sec",
        "total_contention_sec",
        "total_rows_read",
        "total_rows_written",
        "weighted_avg_latency_sec",
        "weighted_avg_contention_sec",
        workload_profile(F.col("total_rows_written"), F.col("total_rows_read")).alias("workload_profile"),
        "involves_full_scan",
        "existing_index_usage",
        impact_score(weights).alias("impact_score"),
        "related_fingerprints",
        "related_applications",
        "sample_queries",
    ).orderBy(F.col("impact_score").desc_nulls_last(), *[F.col(c) for c in TARGET])
