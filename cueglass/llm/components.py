"""Connected components of a graph that is kept in tables from end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueglass.llm.store import written


def connected(links: DataFrame) -> DataFrame:
    """Label every node of ``links`` (a, b) with the smallest node of its component.

    Each round hangs every label under its smallest neighbour label, follows those
    steps to their ends by pointer doubling, and draws the links between the labels
    anew; each label that has a smaller neighbour goes, so at least the larger end of
    every link does. Nulls link nothing; an empty table gives an empty table.
    """
    ends = links.where("a is not null and b is not null and a <> b").select("a", "b")
    ends = written(ends.union(ends.select("b", "a")).distinct())
    labels = ends.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct()
    between = ends.select("a", "b")
    while not between.isEmpty():
        step = written(
            between.groupBy("a").agg(F.min("b").alias("up")).where("up < a")
        )
        while True:
            far = step.select(F.col("a").alias("up"), F.col("up").alias("next"))
            longer = written(
                step.join(far, "up", "left").select(
                    "a", F.coalesce("next", "up").alias("up"), F.col("next").isNotNull().alias("moved")
                )
            )
            step = longer.select("a", "up")
            if longer.where("moved").isEmpty():
                break
        labels = written(
            labels.join(step.withColumnRenamed("a", "label"), "label", "left").select(
                "node", F.coalesce("up", "label").alias("label")
            )
        )
        moved_a = between.join(step, "a", "left").select(F.coalesce("up", "a").alias("a"), "b")
        other = step.select(F.col("a").alias("b"), "up")
        between = written(
            moved_a.join(other, "b", "left")
            .select("a", F.coalesce("up", "b").alias("b"))
            .where("a <> b")
            .distinct()
        )
    return labels
