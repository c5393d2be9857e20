"""Connected components of an edge table, by alternating large-star and
small-star steps (Kiveris et al., 2014) until nothing changes. Every step is a
grouped minimum and a join, each round is written to the shared checkpoint
folder, and no component, however large, meets in one task: minima combine
before the shuffle, and the joins exchange both sides anew so that a hub's
partition can be split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoptally.llm.common import materialize

MAX_ROUNDS = 60


def _with_min(edges: DataFrame) -> DataFrame:
    """(u, v, m): m the least neighbour of u. ``w``, a second key, keeps the
    grouped side's partitioning from being reused by the join."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.hash("u").alias("w"), "m")
    return edges.withColumn("w", F.hash("u")).join(least, ["u", "w"])


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return (_with_min(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
            .where("u != v").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    near = _with_min(edges)
    return near.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).unionByName(
        near.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node but the least of each component, from
    edges (a, b) of any orderable type; loops and NULLs are ignored."""
    e = edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = materialize(e, "edges")
    mark = lambda d: tuple(d.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
    seen = mark(e)
    for _ in range(MAX_ROUNDS if seen[0] else 0):
        e = materialize(_small_star(_large_star(e)), "edges")
        now = mark(e)
        if now == seen:
            break
        seen = now
    else:
        if seen[0]:
            raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
