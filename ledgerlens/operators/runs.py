"""Runs of consecutive values in an ordered sequence, per group.

Fixed values, the worked example: ``[1, 4, 5, 6, 7, 9, 19, 21, 22, 23, 24]``
has runs of length ``[1, 4, 1, 1, 4]``; a run goes on while a value is the
previous value + 1 (a repeat or a step down starts a new run).

One path for groups of any size, in Spark's own window and aggregate
operators, so values keep their exact type:

1. the rows are range partitioned on (group, order), which spreads a big group
   over many partitions, and written once with their partition number
   (``functions.ordered``);
2. a window over (partition, group) -- never more than one partition's rows --
   numbers the rows and marks starts, except for a group's first row in a
   partition;
3. one summary row per (partition, group) tells how many rows and starts lie
   before a partition and which value came last, and decides that first row;
4. the summaries are joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.joins import nullsafe_join
from ledgerlens.functions.ordered import PARTITION, range_tagged

POSITION = "position"
RUN_INDEX = "run_index"
IS_RUN_START = "is_run_start"


def _follows(value: Column, previous: Column) -> Column:
    """Whether a value continues the run of the one before (false where one is missing)."""
    return F.coalesce(value == F.try_add(previous, F.lit(1)), F.lit(False))


def consecutive_runs(
    df: DataFrame,
    group_cols: list[str],
    order_cols: list[str | Column],
    value_col: str,
) -> DataFrame:
    """Add ``is_run_start``, ``position`` and ``run_index`` (both 1-based
    within the group) to every row.

    ``order_cols`` must give a total order inside each group (ties would make
    the result depend on the shuffle).  Column expressions are allowed.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    tagged = range_tagged(df, [F.col(c) for c in group_cols] + order, "runs")
    here = [PARTITION, *group_cols]
    local = Window.partitionBy(*here).orderBy(*order)
    value = F.col(value_col)
    rows = (
        tagged.withColumn("_n", F.row_number().over(local))
        .withColumn("_start", ~_follows(value, F.lag(value).over(local)))
        .withColumn("_starts", F.sum((F.col("_start") & (F.col("_n") > 1)).cast("long")).over(local.rowsBetween(Window.unboundedPreceding, 0)))
    )
    # One row per partition and group it holds: their number is bounded by partitions + groups.
    summary = rows.groupBy(*here).agg(
        F.max("_n").cast("long").alias("_rows"),
        F.max("_starts").alias("_starts_here"),
        F.min_by(value_col, "_n").alias("_first"),
        F.max_by(value_col, "_n").alias("_last"),
    )
    in_order = Window.partitionBy(*group_cols).orderBy(PARTITION)
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.withColumn("_opens", ~_follows(F.col("_first"), F.lag("_last").over(in_order))).withColumn(
        "_total", F.col("_starts_here") + F.col("_opens").cast("long")
    )
    carried = carried.select(
        *here,
        "_opens",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_before"),
        F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_runs_before"),
    )
    return (
        nullsafe_join(rows, carried, here)
        .withColumn(IS_RUN_START, F.when(F.col("_n") == 1, F.col("_opens")).otherwise(F.col("_start")))
        .withColumn(POSITION, F.col("_rows_before") + F.col("_n"))
        .withColumn(RUN_INDEX, F.col("_runs_before") + F.col("_opens").cast("long") + F.col("_starts"))
        .drop(PARTITION, "_n", "_start", "_starts", "_opens", "_rows_before", "_runs_before")
    )


def run_lengths(runs: DataFrame, group_cols: list[str], value_col: str) -> DataFrame:
    """One row per run: its index, length and first value (partial aggregation)."""
    return runs.groupBy(*group_cols, RUN_INDEX).agg(
        F.count(F.lit(1)).cast("int").alias("run_length"),
        F.min_by(F.col(value_col), F.col(POSITION)).alias("first_" + value_col),
    )
