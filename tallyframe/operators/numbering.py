"""Global numbers and running sums without a single-partition window.

A range sort splits the order over partitions; rows are numbered (or summed) within their
partition, and the partitions' offsets, one small row each, are joined back. The sorted rows
are cut at the shared checkpoint folder, so both passes see the same partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.session import cut_lineage


def _sorted(df: DataFrame, order: list[Column]) -> DataFrame:
    # Sorting fixes partitions; the row's partition and place in it are kept as columns.
    return cut_lineage(
        df.sort(*order)
        .withColumn("_id", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_id", 33).cast("int"))
    )


def global_row_number(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """1-based position of every row in the given total order."""
    rows = _sorted(df, order)
    counts = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = F.col("_id") - F.shiftleft(F.col("_part").cast("long"), 33)
    return rows.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_off") + inside + 1).drop("_id", "_part", "_off")


def global_running_sum(df: DataFrame, order: list[Column], value: str, name: str) -> DataFrame:
    """Sum of ``value`` over all earlier rows of the total order (0 for the first; null counts as 0)."""
    rows = _sorted(df.withColumn("_v", F.coalesce(F.col(value), F.lit(0))), order)
    totals = rows.groupBy("_part").agg(F.sum("_v").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy("_part").orderBy("_id").rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_off") + F.coalesce(F.sum("_v").over(inside), F.lit(0)))
        .drop("_id", "_part", "_off", "_v")
    )
