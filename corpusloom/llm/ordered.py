"""Sorted runs and ranks of whole tables, for sweeps that go through rows in order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import shuffle_partitions, stored


def sorted_parts(df: DataFrame, order: Sequence[Column | str], part: str = "_part") -> DataFrame:
    """``df`` in ranges of ``order``, stored; ``part`` numbers the ranges, so rows ascend by ``(part, *order)``.

    Ranges are about equal, also where one key holds much of the table, if ``order`` ends in columns that tell its rows apart.
    The table is written once, so what follows sees the same ranges whichever task runs again.
    """
    ranged = df.repartitionByRange(shuffle_partitions(df.sparkSession), *order).sortWithinPartitions(*order)
    return stored(ranged.withColumn(part, F.spark_partition_id()))


def with_rank(df: DataFrame, group: str, order: Sequence[str], rank: str = "_rank", total: str = "_total") -> DataFrame:
    """Add the 0-based rank of a row in its ``group`` by ``order``, and the group's size; ``group`` must not be null.

    Counts of each range are summed over the ranges of a group, and rows are then numbered within a range only.
    """
    parts = sorted_parts(df, [group, *order])
    counts = parts.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(group, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"), F.sum("_n").over(Window.partitionBy(group)).alias(total))
    within = F.row_number().over(Window.partitionBy(group, "_part").orderBy(*order)) - 1
    # A merge join by hint: rows lie by (group, part) already, so only the counts move.
    return parts.withColumn("_in", within).join(counts.hint("merge"), [group, "_part"]).withColumn(rank, F.col("_off") + F.col("_in")).drop("_part", "_in", "_off")
