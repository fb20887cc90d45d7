"""Gapless row numbers over a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cueglass.llm.store import written


def number_rows(df: DataFrame, order: list[str], number: str, total: str) -> DataFrame:
    """Add the row's place (from 0) in ``order`` and the number of all rows.

    Rows are dealt out by ranges of ``order``. Rows that tie are told apart by their
    place in the input, so a value that fills a third of the table spreads over many
    tasks; rows that are equal in all columns are interchangeable. Only one count per
    range meets in one task.
    """
    placed = written(
        df.withColumn("_tie", F.monotonically_increasing_id())
        .repartitionByRange(*order, "_tie")
        .withColumn("_range", F.spark_partition_id())
    )
    ranges = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = ranges.select(
        "_range",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_base"),
        F.sum("_rows").over(Window.partitionBy()).alias(total),
    )
    inside = Window.partitionBy("_range").orderBy(*order, "_tie")
    return (
        placed.withColumn("_place", F.row_number().over(inside) - 1)
        .join(F.broadcast(bases), "_range")  # one row for each range
        .withColumn(number, F.col("_base") + F.col("_place"))
        .drop("_range", "_tie", "_place", "_base")
    )
