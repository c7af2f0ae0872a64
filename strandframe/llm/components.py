"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is an aggregation and a join over edges; nothing is gathered on the driver but a count and a
checksum that tell when the edges have stopped changing. Each half step is a table in the shared
folder, so the lineage stays short, and joins read such tables directly, so that adaptive execution can
split a hub's edges. The number of rounds grows with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import discard, materialize


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("bit_xor(xxhash64(v, u, 7))")).first())


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) for the nodes of edges(u, v); loops, repeats, nulls and either direction are allowed."""
    now = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = materialize(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-star")
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "lowest")
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        then = materialize(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        for t in (now, least, large, low):
            discard(t)
        now, before = then, mark
        mark = _mark(now)
        if mark == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
