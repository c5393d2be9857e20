"""Ranking inside groups without sending a whole group to one task.

``row_number() OVER (PARTITION BY g ORDER BY id)`` puts every row of a group
into one task; one hot group (a repeated code, a blank key) would then be
processed by a single core. ``row_number_by_id`` computes the same number
in two bounded steps:

1. ids are cut into fixed-width blocks; rows are counted per (group, block)
   with a plain aggregate (partial aggregation on the map side);
2. a running sum over the *block counts* gives each block's offset, and a
   ``row_number`` inside (group, block) - at most ``block`` rows, because ids
   are unique - completes the number.

The block-count window holds one row per non-empty block of a group, i.e.
at most (id range / block) rows. Ids are assumed to be identity-like (dense);
with very sparse ids the block summary approaches the row count.

Ranking a whole frame (no group) makes no such assumption: rows are range
partitioned by id from a sample, so the one summary has a row per partition.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize_lean as materialize


def row_number_by_id(df: DataFrame, group_cols: list[str], id_col: str, out: str = "row_no", block: int = 65536) -> DataFrame:
    """Add ``out`` = row_number() over (partition by group_cols order by id_col).

    ``id_col`` must be an integral column unique within each group; with no
    group columns the whole frame is one group.
    """
    if not group_cols:
        return _numbered(df, id_col, out)
    blk = F.floor(F.col(id_col) / F.lit(block)).alias("_blk")
    keyed = df.withColumn("_blk", blk)
    counts = keyed.groupBy(*group_cols, "_blk").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group_cols).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *[F.col(c).alias(f"_o_{c}") for c in group_cols],
        F.col("_blk").alias("_o_blk"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"),
    )
    cond = reduce(
        lambda a, b: a & b,
        [keyed[c].eqNullSafe(offsets[f"_o_{c}"]) for c in group_cols] + [keyed["_blk"] == offsets["_o_blk"]],
    )
    local = Window.partitionBy(*group_cols, "_blk").orderBy(id_col)
    return (
        keyed.join(offsets, cond)
        .withColumn(out, (F.col("_off") + F.row_number().over(local)).cast("bigint"))
        .drop("_blk", "_off", "_o_blk", *[f"_o_{c}" for c in group_cols])
    )


def _numbered(df: DataFrame, id_col: str, out: str) -> DataFrame:
    """Add each row's place in the order of ``id_col``, from 1; rows of equal id take turns.

    ``monotonically_increasing_id`` of sorted ranges is (partition, place). It
    is written, so that the counts and the rows see the same ranges.
    """
    placed = df.repartitionByRange(id_col).sortWithinPartitions(id_col).withColumn("_at", F.monotonically_increasing_id())
    placed = materialize(placed, "numbered").withColumns({"_part": F.shiftright("_at", 33), "_at": F.col("_at").bitwiseAND((1 << 33) - 1)})
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_part_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_part_rows").over(before), F.lit(0)).alias("_off"))
    return placed.join(offsets, "_part").select(*df.columns, (F.col("_off") + F.col("_at") + 1).cast("bigint").alias(out))


def running_sums_by_id(df: DataFrame, group_cols: list[str], id_col: str, sums: dict[str, Column], block: int = 65536,
                       then: list[str] | None = None) -> DataFrame:
    """Add each ``sums[name]`` summed over the group's rows of smaller ``id_col``
    (0 for the first), in the same two bounded steps: block sums, a running sum
    over them, and a running sum inside (group, block). Group columns are not
    NULL. ``then`` orders rows of equal id."""
    keyed = df.select("*", *[F.coalesce(c, F.lit(0)).alias(f"_v_{n}") for n, c in sums.items()], F.floor(F.col(id_col) / F.lit(block)).alias("_blk"))
    totals = keyed.groupBy(*group_cols, "_blk").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    before = Window.partitionBy(*group_cols).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*group_cols, "_blk", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums])
    local = Window.partitionBy(*group_cols, "_blk").orderBy(id_col, *(then or [])).rowsBetween(Window.unboundedPreceding, -1)
    out = keyed.join(offsets, [*group_cols, "_blk"])
    out = out.select("*", *[(F.col(f"_o_{n}") + F.coalesce(F.sum(f"_v_{n}").over(local), F.lit(0))).alias(n) for n in sums])
    return out.drop("_blk", *[f"_{p}_{n}" for n in sums for p in "vo"])


def next_ids(df: DataFrame, group_cols: list[str], id_col: str, flags: dict[str, Column], block: int = 65536) -> DataFrame:
    """Add each ``flags[name]``'s least larger ``id_col`` among the group's rows
    where the flag is true (NULL if there is none), in the same two bounded
    steps, from the end. Group columns are not NULL."""
    keyed = df.select("*", *[F.when(c, F.col(id_col)).alias(f"_v_{n}") for n, c in flags.items()], F.floor(F.col(id_col) / F.lit(block)).alias("_blk"))
    least = keyed.groupBy(*group_cols, "_blk").agg(*[F.min(f"_v_{n}").alias(f"_t_{n}") for n in flags])
    after = Window.partitionBy(*group_cols).orderBy(F.desc("_blk")).rowsBetween(Window.unboundedPreceding, -1)
    later = least.select(*group_cols, "_blk", *[F.min(f"_t_{n}").over(after).alias(f"_o_{n}") for n in flags])
    local = Window.partitionBy(*group_cols, "_blk").orderBy(F.desc(id_col)).rowsBetween(Window.unboundedPreceding, -1)
    out = keyed.join(later, [*group_cols, "_blk"])
    out = out.select("*", *[F.coalesce(F.min(f"_v_{n}").over(local), F.col(f"_o_{n}")).alias(n) for n in flags])
    return out.drop("_blk", *[f"_{p}_{n}" for n in flags for p in "vo"])
