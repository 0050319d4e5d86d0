"""Session settings and the one place where intermediate results are written."""

from __future__ import annotations

import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

# Read when a session is built; every one can be overridden by the cluster.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def build_session(app_name: str = "runlens", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULT_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_local_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's folder for cut lineage; where it is unset, a throw-away one in local mode, else an error."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    if context.master != "local" and not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _local_folders:
        _local_folders[context.applicationId] = tempfile.mkdtemp(prefix="runlens-")
    return _local_folders[context.applicationId]


def materialise(df: DataFrame, label: str, folder: str) -> DataFrame:
    """Write ``df`` to ``folder``, which all executors share, and read it back.

    Used where one result feeds several branches of a plan: the branches read
    files (with known sizes, and safe against lost executors) in place of
    recomputing the joins above.
    """
    path = f"{folder.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialise_all(frames: dict[str, DataFrame], folder: str) -> dict[str, DataFrame]:
    """Several independent results at once: their jobs share the cluster."""
    with ThreadPoolExecutor(max_workers=max(1, len(frames))) as pool:
        written = pool.map(lambda item: materialise(item[1], item[0], folder), frames.items())
        return dict(zip(frames, written))
