"""Keyed merges: insert-if-absent and insert-or-update."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens.operators.ranking import first_per_group

#: 128 bits of a key, in two independent halves
KEY_DIGEST = T.StructType([T.StructField("digest_1", T.LongType()), T.StructField("digest_2", T.LongType())])
KEY_BUCKETS = 256


def insert_ignore(
    source: DataFrame, target: DataFrame | None, keys: dict[str, Column], order: Sequence[Column]
) -> DataFrame:
    """Source rows whose key is new, one per key: the rows to append.

    ``keys`` maps key names to expressions valid on both sides. The source is
    cut to one row per key before it meets the target, of which only the key
    columns are read.
    """
    named = source.withColumns({f"_key_{name}": expr for name, expr in keys.items()})
    names = [f"_key_{name}" for name in keys]
    fresh = first_per_group(named, names, order)
    if target is not None:
        seen = target.select(*[expr.alias(f"_key_{name}") for name, expr in keys.items()])
        fresh = fresh.join(seen, names, "left_anti")
    return fresh.drop(*names)


def with_key_digest(df: DataFrame, keys: dict[str, Column], buckets: int = KEY_BUCKETS) -> DataFrame:
    """``df`` with the digest of a key and the bucket of an index it belongs to.

    As in a unique constraint a key with a NULL is in no index: its digest and bucket are NULL.
    """
    whole = F.lit(True)
    for k in keys.values():
        whole &= k.isNotNull()
    one, two = F.xxhash64(*keys.values()), F.xxhash64(F.lit(2), *keys.values())
    return df.withColumns(
        {
            "digest_1": F.when(whole, one),
            "digest_2": F.when(whole, two),
            "bucket": F.when(whole, F.pmod(one, F.lit(buckets))),
        }
    )


def not_in_index(fresh: DataFrame, seen: DataFrame) -> DataFrame:
    """Rows whose key digest the index does not hold; ``seen`` needs to have their buckets only."""
    keys = ["test_run", "bucket", *KEY_DIGEST.names]
    return fresh.join(seen.select(*keys), keys, "left_anti").select(*fresh.columns)


def upsert(
    source: DataFrame,
    target: DataFrame,
    keys: Sequence[str],
    updated: Sequence[str],
    order: Sequence[Column] | None = None,
) -> DataFrame:
    """The merged table: ``updated`` columns from the source where the key is
    present there (a NULL counts as a value), all others from the first row.

    ``order`` picks one source row per key where the source repeats keys.
    """
    if order is not None:
        source = first_per_group(source, keys, order)
    old, new = target.alias("old"), source.alias("new")
    condition = None
    for k in keys:
        # as in a unique constraint, a NULL in the key never conflicts
        term = F.col(f"old.{k}") == F.col(f"new.{k}")
        condition = term if condition is None else condition & term
    joined = old.withColumn("_old", F.lit(True)).alias("old").join(
        new.withColumn("_new", F.lit(True)).alias("new"), condition, "full_outer"
    )
    columns = []
    for c in target.columns:
        if c in updated:
            value = F.when(F.col("new._new"), F.col(f"new.{c}")).otherwise(F.col(f"old.{c}"))
        else:
            value = F.when(F.col("old._old"), F.col(f"old.{c}")).otherwise(F.col(f"new.{c}"))
        columns.append(value.alias(c))
    return joined.select(*columns)
