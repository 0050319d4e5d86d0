"""Sampling operators and keyed bulk updates."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Draw = Callable[[int], Column]


def keyed_draw(key: str, seed: int) -> Draw:
    """Uniform numbers in [0, 1) that depend on the key and seed only.

    Unlike ``rand`` they do not change when a lost task runs again on other
    partitions. Each call number gives an independent sequence.
    """

    def draw(n: int) -> Column:
        digest = F.md5(F.concat_ws("/", F.lit(str(seed)), F.lit(str(n)), F.col(key).cast("string")))
        return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(16**12))

    return draw


def random_sample(df: DataFrame, key: str, k: int, seed: int = 0) -> DataFrame:
    """``k`` rows in random order of their keys; a heap of ``k`` per task."""
    order = F.md5(F.concat_ws("/", F.lit(str(seed)), F.col(key).cast("string")))
    return df.orderBy(order, F.col(key)).limit(k)


def offset_slice(df: DataFrame, key: str, offset: int, k: int, parts: int = 1024, small: int = 100_000) -> DataFrame:
    """The ``k`` rows after the first ``offset`` in the order of a whole-number key.

    ``OFFSET n`` alone would bring the first n rows to one task. Here the key
    range is narrowed first: each pass counts the rows in ``parts`` equal
    ranges and moves to the one where the offset falls, until few enough rows
    are left to skip. The final read is closed at the range in which the slice
    ends, so it touches only the row groups around the slice. Rows with a NULL
    key are not part of the order. Rows that share one key are skipped by their
    number within that key, in any order, as they are equal to it.
    """
    if not isinstance(df.schema[key].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        raise ValueError(f"{key} must be a whole-number column")
    bounds = df.agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.count(key).alias("n")).first()
    if not bounds["n"] or offset >= bounds["n"]:
        return df.limit(0)
    lo, hi, n, skip = int(bounds["lo"]), int(bounds["hi"]), bounds["n"], offset
    end = hi
    while n > small and lo < hi:
        width = -(-(hi - lo + 1) // parts)
        counted = (
            df.where(F.col(key).between(lo, hi))
            .groupBy(F.expr(f"({key} - {lo}) div {width}").alias("part"))
            .count()
            .orderBy("part")
            .collect()
        )
        at = 0
        while skip >= counted[at]["count"]:
            skip -= counted[at]["count"]
            at += 1
        held, last = counted[at]["count"] - skip, at
        while held < k and last + 1 < len(counted):
            last += 1
            held += counted[last]["count"]
        if held >= k:
            end = min(end, lo + (counted[last]["part"] + 1) * width - 1)
        lo, hi, n = lo + counted[at]["part"] * width, min(hi, lo + (counted[at]["part"] + 1) * width - 1), counted[at]["count"]
    rest = df.where(F.col(key).between(lo, end)).orderBy(key)
    return rest.offset(skip).limit(k) if skip else rest.limit(k)


def random_offset(rows: int, u: float) -> int:
    """A random start in the first tenth of the table, for ``u`` in [0, 1)."""
    return math.floor(u * rows / 10)


def update_keyed(
    df: DataFrame, keys: DataFrame | None, key: str, changes: dict[str, Column]
) -> DataFrame:
    """Apply ``changes`` to the rows whose key is in ``keys``; others stay.

    How the keys meet the table is left to the planner, by their size at run
    time. Without ``keys`` every row changes (combine with :func:`update_where`).
    """
    if keys is None:
        return df.withColumns(changes)
    picked = keys.select(F.col(key).alias("_picked")).where("_picked IS NOT NULL").distinct()
    joined = df.join(picked, df[key] == picked["_picked"], "left")
    hit = F.col("_picked").isNotNull()
    return joined.withColumns(
        {c: F.when(hit, e).otherwise(F.col(c)) for c, e in changes.items()}
    ).select(*df.columns)


def update_where(df: DataFrame, condition: Column, changes: dict[str, Column]) -> DataFrame:
    """Apply ``changes`` to the rows that meet a predicate."""
    return df.withColumns({c: F.when(condition, e).otherwise(F.col(c)) for c, e in changes.items()})


# --- the expressions of the keyed updates, for update_keyed -------------------

def shifted_minutes(ts: Column, draw: Draw, first: int = 0) -> Column:
    """A timestamp moved 5 to 60 whole minutes into the past or the future."""
    sign = F.when(draw(first) < 0.5, F.lit(1)).otherwise(F.lit(-1))
    minutes = (F.floor(draw(first + 1) * 56) + 5).cast("int")
    return ts + F.make_dt_interval(mins=sign * minutes)


def picked_status(statuses: Sequence[str], draw: Draw, n: int = 0) -> Column:
    values = F.array(*[F.lit(s) for s in statuses])
    return F.element_at(values, (F.floor(draw(n) * len(statuses)) + 1).cast("int"))


def scaled_seats(seats: Column, draw: Draw, n: int = 0) -> Column:
    """Seats changed by -2.5 % to +7.5 %, rounded to a whole number."""
    return F.round(seats.cast("double") * (F.lit(1.0) + (draw(n) - 0.25) / 10)).cast("bigint")


def scaled_price(price: Column, draw: Draw, n: int = 0) -> Column:
    """A price changed by up to 5 % either way."""
    return price * (F.lit(1.0) + (draw(n) - 0.5) / 10)
