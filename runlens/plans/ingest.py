"""Batch ingest of the four streams into the tables segmented by test run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens import schemas as S
from runlens.operators.joins import interval_join
from runlens.operators.merging import insert_ignore, upsert, with_key_digest
from runlens.operators.ranking import first_per_group

INSIGHT_ORDER = ("start_time", "stmt_id", "txn_id")


def insight_keys() -> dict[str, Column]:
    """The six-part insight key with a missing error folded to a fixed text."""
    keys = {k: F.col(k) for k in S.KEYS["insights"]}
    keys["last_error_redactable"] = F.coalesce("last_error_redactable", F.lit(S.NO_ERROR))
    return keys


def tag_with_runs(source: DataFrame, slices: DataFrame, stream: str) -> DataFrame:
    """Source rows inside a due slice, once per run they belong to.

    Live streams must also match the run's database; statistics do not.
    """
    if stream not in S.ALL_STREAMS:
        raise ValueError(f"unknown stream {stream!r}")
    mine = slices.where(F.col("stream") == stream)
    if stream in S.LIVE_STREAMS:
        equal = [("database_name", "database_name")]
        mine = mine.select("test_run", "database_name", "from_ts", "to_ts")
    else:
        equal = []
        mine = mine.select("test_run", "from_ts", "to_ts")
    tagged = interval_join(source, mine, S.EVENT_TIME[stream], "from_ts", "to_ts", equal)
    return tagged.select("test_run", *source.columns)


def new_contention(source: DataFrame, slices: DataFrame) -> DataFrame:
    """Contention rows to append; repeated events stay repeated."""
    return tag_with_runs(source, slices, "contention")


def visible_insights(source: DataFrame, slices: DataFrame) -> DataFrame:
    return tag_with_runs(source.where(F.col("query") != S.HIDDEN_QUERY), slices, "insights")


def new_insights(tagged: DataFrame, target: DataFrame | None) -> DataFrame:
    """Tagged insight rows whose key is not yet in the target, first one wins."""
    return insert_ignore(tagged, target, insight_keys(), [F.col(c) for c in INSIGHT_ORDER])


def new_txn_ids(tagged: DataFrame, target: DataFrame | None) -> DataFrame:
    """Transaction id to fingerprint, one row per (run, id) that is not yet mapped."""
    fresh = tagged.groupBy("test_run", "txn_id").agg(F.min("txn_fingerprint_id").alias("txn_fingerprint_id"))
    if target is None:
        return fresh
    return fresh.join(target.select("test_run", "txn_id"), ["test_run", "txn_id"], "left_anti")


def indexed_insights(tagged: DataFrame) -> DataFrame:
    """The first row of every insight key in a batch, with its place in the key index."""
    return with_key_digest(new_insights(tagged, None), insight_keys())


def indexed_txn_ids(tagged: DataFrame) -> DataFrame:
    """One row per (run, transaction id) of a batch, with its place in the key index."""
    return with_key_digest(new_txn_ids(tagged, None), {k: F.col(k) for k in S.KEYS["txn_id_map"]})


def _newest_first() -> list[Column]:
    """Versions of one bucket: its execution count only grows; equal counts end in a fixed order."""
    count = F.get_json_object("statistics", "$.statistics.cnt").cast("bigint")
    return [count.desc_nulls_last(), F.xxhash64("statistics", "metadata")]


def newest_statistics(tagged: DataFrame, stream: str) -> DataFrame:
    """One row per key: the newest version of each bucket. A NULL in the key never conflicts."""
    keys = list(S.KEYS[stream])
    whole = F.lit(True)
    for k in keys:
        whole &= F.col(k).isNotNull()
    # rows with a NULL in the key are groups of their own, so the source is read once
    own = F.when(~whole, F.monotonically_increasing_id())
    return first_per_group(tagged.withColumn("_own", own), [*keys, "_own"], _newest_first()).drop("_own")


def merged_statistics(tagged: DataFrame, target: DataFrame, stream: str) -> DataFrame:
    """The statistics table after an upsert; the first row's interval is kept."""
    return upsert(newest_statistics(tagged, stream), target, S.KEYS[stream], S.UPDATED_COLUMNS[stream])


def normalised_recommendations(col: str | Column, dtype: T.DataType) -> Column:
    """Index recommendations as an array of texts.

    NULL stays NULL, a single value becomes an array of one; structured
    elements become compact JSON and all others plain text.
    """
    column = F.col(col) if isinstance(col, str) else col

    def as_text(x: Column, t: T.DataType) -> Column:
        if isinstance(t, (T.StructType, T.MapType, T.ArrayType)):
            return F.to_json(x)
        return x.cast("string")

    if isinstance(dtype, T.ArrayType):
        return F.transform(column, lambda x: as_text(x, dtype.elementType))
    return F.when(column.isNotNull(), F.array(as_text(column, dtype)))


def load_counts(tables: dict[str, DataFrame], slices: DataFrame | None = None) -> DataFrame:
    """Rows per run and stream, within the slices if given.

    Slices are adjacent, so a row is counted once per run and slice it is in.
    """
    parts = None
    for stream, df in tables.items():
        ts = S.EVENT_TIME[stream]
        slim = df.select("test_run", F.col(ts).alias("ts"))
        if slices is not None:
            mine = slices.where(F.col("stream") == stream).select("test_run", "from_ts", "to_ts")
            slim = interval_join(slim, mine, "ts", "from_ts", "to_ts", [("test_run", "test_run")])
        part = slim.groupBy("test_run").agg(F.count(F.lit(1)).alias("rows")).withColumn("stream", F.lit(stream))
        parts = part if parts is None else parts.unionByName(part)
    return parts.select("test_run", "stream", "rows")


def load_summary(counts: DataFrame, runs: DataFrame, run_time: Column | None = None) -> DataFrame:
    """One row per run with the four counts, zero where nothing was loaded."""
    names = {
        "contention": "contention",
        "insights": "insights",
        "stmt_stats": "statements",
        "txn_stats": "transactions",
    }
    sums = counts.groupBy("test_run").agg(
        *[F.sum(F.when(F.col("stream") == s, F.col("rows"))).alias(n) for s, n in names.items()]
    )
    out = runs.select("test_run").join(sums, "test_run", "left")
    columns = [F.col("test_run")]
    if run_time is not None:
        columns.append(run_time.alias("run_time"))
    return out.select(*columns, *[F.coalesce(n, F.lit(0)).alias(n) for n in names.values()])


def summary_json(summary: DataFrame) -> DataFrame:
    """The load summary as JSON objects, one per run, ordered by run."""
    return summary.orderBy("test_run").select(F.to_json(F.struct(*summary.columns)).alias("result"))
