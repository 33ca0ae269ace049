"""Distributed row numbering: over a table, and inside groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from normlens.session import materialize


def global_row_index(df: DataFrame, order_col: str, name: str = "rn") -> DataFrame:
    """0-based position of each row of the table in the order of ``order_col``."""
    return row_ranks(df, [], [order_col], name)


def row_ranks(df: DataFrame, group_cols: list[str], order: list, name: str = "rank") -> DataFrame:
    """0-based position of each row inside its group, by any order of any columns.

    ``order`` holds column names or sort expressions (``F.col("x").desc_nulls_last()``).
    Rows are range-partitioned by group and order, so the rows of one group, or
    of the whole table when ``group_cols`` is empty, may lie in many partitions;
    they are stored in that layout with their place in it.  Rows are then
    counted per (partition, group), and the counts of earlier partitions are
    added to the place inside the partition.  Rows that tie in every key get
    distinct positions in stored order.  NULL groups are groups.
    """
    spark = df.sparkSession
    keys = [*group_cols, *order]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = (df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
            .withColumn("__row", F.monotonically_increasing_id()))
    laid = materialize(laid, "ranked")  # partition number in the upper bits, place in the partition below
    part = F.shiftright("__row", 33).alias("__part")
    blocks = laid.groupBy(part, *group_cols).agg(F.min("__row").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*group_cols).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select(*(F.col(c).alias(f"__g{i}") for i, c in enumerate(group_cols)), F.col("__part").alias("__p"),
                            "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    if not group_cols:
        offsets = F.broadcast(offsets)  # one row per partition of the layout
    match = F.shiftright("__row", 33) == F.col("__p")
    for i, c in enumerate(group_cols):
        match = match & F.col(c).eqNullSafe(F.col(f"__g{i}"))
    return laid.join(offsets, match).select(
        *df.columns, (F.col("__row") - F.col("__first") + F.col("__before")).alias(name))
