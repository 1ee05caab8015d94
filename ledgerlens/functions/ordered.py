"""Order-dependent columns over groups of any size.

A window per group sorts a whole group in one task.  Here the rows are range
partitioned on (group, order) instead, so a big group spans many partitions;
each row keeps the number of its partition, a window over (partition, group)
never sees more than one partition's rows, and a small table of per-partition
summaries (one row per partition and group it holds) gives the offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.joins import nullsafe_join
from ledgerlens.session import materialize

PARTITION = "_ordered_pid"


def range_tagged(df: DataFrame, keys: list[Column], label: str = "ordered") -> DataFrame:
    """``df`` range partitioned on ``keys`` with the partition number as a column.

    Written once: the number of a row must not change when a task is rerun,
    since the range sampler may then choose other bounds.  Rows with equal
    ``keys`` share a partition.
    """
    return materialize(df.repartitionByRange(*keys).withColumn(PARTITION, F.spark_partition_id()), label)


def row_numbers(df: DataFrame, group_cols: list[str], order: list[Column], name: str) -> DataFrame:
    """Add a gapless 0-based ``name`` (long) per group, in the given order.

    ``order`` should be total inside a group; rows that tie get distinct
    numbers in an arbitrary order.  Null group keys form a group of their own.
    """
    groups = [F.col(c) for c in group_cols]
    tagged = range_tagged(df, groups + order, name)
    counts = tagged.groupBy(PARTITION, *group_cols).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group_cols).orderBy(PARTITION).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        PARTITION, *group_cols, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    local = Window.partitionBy(PARTITION, *group_cols).orderBy(*order)
    numbered = tagged.withColumn("_local", F.row_number().over(local))
    return (
        nullsafe_join(numbered, offsets, [PARTITION, *group_cols])
        .withColumn(name, F.col("_offset") + F.col("_local") - 1)
        .drop("_offset", "_local", PARTITION)
    )
