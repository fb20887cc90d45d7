"""Building blocks that keep large groups out of single tasks."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from cueglass.config import DEFAULT, Limits


def set_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that ``spark.checkpoint.dir`` names.

    Only a session that runs in this one process may do without it: it gets a scratch
    folder. On a cluster a missing setting is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="cueglass-")
    context.setCheckpointDir(shared)


#: Takes the shuffle files of a query away when it ends, instead of at some later time.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_end(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def _place(spark: SparkSession, path: str) -> tuple:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder once; later steps read it from there.

    It is written as Parquet, so a later step reads only the columns it needs and the
    planner knows the size. What was shuffled to make it goes at once, as nothing reads it
    again. The files go when the application ends, or by :func:`free`.
    """
    spark = df.sparkSession
    set_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
    with _shuffles_end(spark):
        df.write.option("compression", "zstd").parquet(path)
    files, place = _place(spark, path)
    files.deleteOnExit(place)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._cut_to = path
    return stored


def free(*stored: DataFrame) -> None:
    """Delete tables that :func:`cut` gave, once all that was made of them is stored itself."""
    for df in stored:
        files, place = _place(df.sparkSession, df._cut_to)
        files.delete(place, True)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` for a join that must not send it, or the other side, whole to the driver.

    Spark guesses the size of exploded rows by that of the rows before, and of stored ones
    by their compressed files, so it would take tables of any size for small ones.
    """
    return df.hint("merge")


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """First ``k`` rows of each group. Spark prunes to ``k`` per task before the shuffle."""
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("rank") <= k)


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group as a partial aggregate, so a huge group stays spread.

    ``order`` holds ascending sort keys that must be unique within a group.
    """
    rest = [c for c in df.columns if c not in keys]
    ranked = df.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])).alias(
            "_first"
        )
    )
    return ranked.select(*keys, "_first.*")


def _numbering(group: str) -> Callable:
    """Adds ``_place``: the number of a row, from 1, among those of its group before it."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0  # rows of the last batch's last group
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            runs = pc.run_end_encode(batch.column(group))
            ends = runs.run_ends.to_numpy().astype(np.int64)
            starts = np.concatenate([[0], ends[:-1]])
            first, newest = runs.values[0].as_py(), runs.values[-1].as_py()
            if seen and first == last:
                starts[0] = -seen
            place = np.arange(1, batch.num_rows + 1) - np.repeat(starts, np.diff(ends, prepend=0))
            last, seen = newest, int(place[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place)], names=[*batch.schema.names, "_place"])

    return number


def rank_in_group(df: DataFrame, group: str, order: list[Column], out: str) -> DataFrame:
    """Add each row's place, from 1, in its ``group`` by ``order``, ties in any order.

    Rows are dealt out by ranges of group and order, so a group that holds a third of the
    table spreads over a third of the ranges. They are numbered as they stand in their range,
    so they move once; only the first group of a range can have rows in the ranges before,
    and the number of those is looked up, one for each range.
    """
    spark = df.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(group), *order]
    ranges = df.repartitionByRange(tasks, *by).sortWithinPartitions(*by)
    schema = StructType([*df.schema, StructField("_range", IntegerType()), StructField("_place", LongType())])
    dealt = cut(ranges.withColumn("_range", F.spark_partition_id()).mapInArrow(_numbering(group), schema))
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = dealt.groupBy(group, "_range").agg(F.count(F.lit(1)).alias("_rows")).select(
        F.col(group).alias("_group"), F.col("_range").alias("_at"), F.sum("_rows").over(before).alias("_base")
    )
    same = dealt[group].eqNullSafe(F.col("_group")) & (dealt["_range"] == F.col("_at"))
    return (
        dealt.join(F.broadcast(cut(bases.where("_base > 0"))), same, "left")
        .withColumn(out, (F.coalesce("_base", F.lit(0)) + F.col("_place")).cast("int"))
        .drop("_range", "_place", "_base", "_group", "_at")
    )


def salted(
    many: DataFrame, few: DataFrame, keys: list[str], limits: Limits = DEFAULT
) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join by ``keys`` with the column ``_salt`` to join by as well.

    A key with more than ``hot_pairs`` pairs is split: its rows of ``many`` are spread
    over buckets of about that many pairs and its rows of ``few`` are copied into
    each bucket. The list of such keys is joined by key, so it may grow with the data.
    """
    met = F.col("_many") * F.col("_few")
    buckets = F.least(F.ceil(met / limits.hot_pairs), F.col("_many"))
    hot = (
        many.groupBy(*keys).agg(F.count(F.lit(1)).alias("_many"))
        .join(few.groupBy(*keys).agg(F.count(F.lit(1)).alias("_few")), keys)
        .where(met > limits.hot_pairs)
        .select(*keys, buckets.cast("int").alias("_salts"))
    )
    spread = F.pmod(F.xxhash64(*many.columns), F.col("_salts")).cast("int")
    left = many.join(hot, keys, "left").withColumn("_salt", F.coalesce(spread, F.lit(0)))
    copies = F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)
    right = few.join(hot, keys, "left").withColumn("_salt", F.explode(copies))
    return left.drop("_salts"), right.drop("_salts")


def skew_join(
    many: DataFrame,
    few: DataFrame,
    keys: list[str],
    limits: Limits = DEFAULT,
) -> DataFrame:
    """Inner equi-join for keys that repeat on both sides and so meet in many pairs.

    Keys of very many pairs are split by :func:`salted`. Small rows may meet in very many
    pairs, so both sides are spread over all shuffle partitions instead of being packed
    together by size.
    """
    tasks = int(many.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left, right = salted(many, few, keys, limits)
    on = [*keys, "_salt"]
    return left.repartition(tasks, *on).join(right.repartition(tasks, *on), on).drop("_salt")


def running_total(
    df: DataFrame,
    group: str,
    order: str,
    value: str,
    out: str,
    chunk: int = DEFAULT.running_chunk,
) -> DataFrame:
    """Sum of ``value`` over the rows before this one, per group, by an integer order.

    The group is cut into chunks of the order column. Each chunk is summed by a
    partial aggregate, only the chunk sums are put in sequence per group, and the
    rows are put in sequence per chunk, so a huge group runs as many tasks.
    """
    chunked = df.withColumn("_chunk", F.floor(F.col(order) / chunk))
    sums = chunked.groupBy(group, "_chunk").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(
        group, "_chunk", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base")
    )
    inside = (
        Window.partitionBy(group, "_chunk")
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    total = F.col("_base") + F.coalesce(F.sum(value).over(inside), F.lit(0))
    return (
        chunked.join(shuffled(bases), [group, "_chunk"]).withColumn(out, total).drop("_chunk", "_base")
    )


def previous_value(
    df: DataFrame,
    group: str,
    order: str,
    value: str,
    out: str,
    chunk: int = DEFAULT.running_chunk,
) -> DataFrame:
    """``value`` of the row before this one, per group, by an integer order.

    Works chunk by chunk; the last value of the chunk before is carried over.
    """
    chunked = df.withColumn("_chunk", F.floor(F.col(order) / chunk))
    lasts = chunked.groupBy(group, "_chunk").agg(F.max_by(value, order).alias("_last"))
    across = Window.partitionBy(group).orderBy("_chunk")
    carried = lasts.select(group, "_chunk", F.lag("_last").over(across).alias("_carried"))
    inside = Window.partitionBy(group, "_chunk").orderBy(order)
    first = F.row_number().over(inside) == 1
    before = F.when(first, F.col("_carried")).otherwise(F.lag(value).over(inside))
    return (
        chunked.join(shuffled(carried), [group, "_chunk"])
        .withColumn(out, before)
        .drop("_chunk", "_carried")
    )
