"""Ordered scans that never put a whole stream into one task.

Two shapes cover everything: a dense index per stream, and values carried forward along
it. Both work block by block; only one narrow row per block crosses block borders.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxframe.session import materialize

CARRY_BLOCK = 4096


def index_rows(df: DataFrame, key: str, order_by: Sequence[str], name: str) -> DataFrame:
    """Add ``name``: the 0-based position of each row within ``key`` by ``order_by``.

    Rows are range-partitioned and sorted on (key, order), so a key with most of the rows
    spreads over many partitions. The positions are written once, which fixes the range
    borders, and one count per (key, partition) turns local positions into global ones.
    ``order_by`` must be unique within a key.
    """
    placed = materialize(
        df.repartitionByRange(key, *order_by)
        .sortWithinPartitions(key, *order_by)
        .withColumn("_pos", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_pos", 33))
    )
    parts = placed.groupBy(key, "_part").agg(
        F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    earlier = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = parts.select(
        key, "_part",
        (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"),
    )
    return (
        placed.join(shift, [key, "_part"])
        .withColumn(name, F.col("_pos") + F.col("_shift"))
        .drop("_pos", "_part", "_shift")
    )


def carry_forward(
    df: DataFrame,
    stream: str,
    index: str,
    values: dict[str, str],
    block_size: int = CARRY_BLOCK,
) -> DataFrame:
    """Add, for each ``source -> name`` in ``values``, the last non-null earlier value.

    Inside a block of ``block_size`` index positions this is a window; what enters a block
    comes from a table with one row per block.
    """
    block = F.floor(F.col(index) / block_size)
    inner = Window.partitionBy(stream, "_block").orderBy(index).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(stream).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocked = df.withColumn("_block", block)
    lasts = blocked.groupBy(stream, "_block").agg(*[
        F.max_by(F.col(src), F.when(F.col(src).isNotNull(), F.col(index))).alias(f"_last_{name}")
        for src, name in values.items()
    ])
    entering = lasts.select(stream, "_block", *[
        F.last(f"_last_{name}", ignorenulls=True).over(outer).alias(f"_in_{name}")
        for name in values.values()
    ])
    inside = blocked.select("*", *[
        F.last(src, ignorenulls=True).over(inner).alias(f"_own_{name}") for src, name in values.items()
    ])
    return inside.join(entering, [stream, "_block"]).select(
        *df.columns,
        *[F.coalesce(f"_own_{name}", f"_in_{name}").alias(name) for name in values.values()],
    )


def running_total(
    df: DataFrame, stream: str, index: str, value: str, name: str, block_size: int = CARRY_BLOCK
) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the earlier rows of the stream."""
    inner = Window.partitionBy(stream, "_block").orderBy(index).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(stream).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocked = df.withColumn("_block", F.floor(F.col(index) / block_size))
    entering = (
        blocked.groupBy(stream, "_block").agg(F.sum(value).alias("_sum"))
        .select(stream, "_block", F.coalesce(F.sum("_sum").over(outer), F.lit(0)).alias("_in"))
    )
    return (
        blocked.withColumn("_own", F.coalesce(F.sum(value).over(inner), F.lit(0)))
        .join(entering, [stream, "_block"])
        .select(*df.columns, (F.col("_own") + F.col("_in")).alias(name))
    )
