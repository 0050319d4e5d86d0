"""Connected components of a link table: each node gets the least node it can reach."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.scratch import keep


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """One large-star or small-star step: neighbours are hung on the least node around them."""
    if large:
        ends = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        ends = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    # written, so that the join can be split at run time where a node has very many links
    least = keep(ends.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u")), "least")
    joined = ends.join(least, "u")
    if large:
        hung = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        hung = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
    return hung.filter(F.col("u") != F.col("v")).distinct()


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v").cast("long"))).first()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """``links(u, v)`` of longs to ``(node, component)``, without nodes that have no link.

    Alternating large-star and small-star steps until nothing changes; each
    round is written to the shared folder, so its plan stays short.
    """
    now = keep(links.filter(F.col("u") != F.col("v")).select("u", "v").distinct(), "links")
    state = _state(now)
    while True:
        now = keep(_stars(_stars(now, True), False), "links")
        after = _state(now)
        if after == state:
            break
        state = after
    tree = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return tree.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).groupBy("node").agg(
        F.min("component").alias("component")
    )
