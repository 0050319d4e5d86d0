"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a temporary folder if all runs in one process, else an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.conf.get("spark.master", None) or ""
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="llm-"))
    return f"file://{_local[0]}"


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/llm/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet and read it again: cuts the lineage and computes shared parts once."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def blocks(spark: SparkSession, per_partition: int = 2) -> int:
    """How many groups to deal rows into: in proportion to the session's shuffle partitions."""
    return max(1, per_partition * int(spark.conf.get("spark.sql.shuffle.partitions")))
