"""Selected words of a clip: event folds, contiguous blocks, edges."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueglass.config import DEFAULT, Limits
from cueglass.operators.scale import cut, previous_value, rank_in_group, running_total, shuffled


class Runs:
    """Selected indexes as sorted, disjoint, unconnected runs ``starts[i] .. ends[i]``.

    A run is found by binary search, so an event costs the same for ten words and for ten
    million, and the state holds runs, not words.
    """

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []

    def run_of(self, word: int) -> tuple[int, int] | None:
        """First and last index of the unbroken selected run that holds ``word``."""
        i = bisect_right(self.starts, word) - 1
        return (self.starts[i], self.ends[i]) if i >= 0 and self.ends[i] >= word else None

    def add(self, low: int, high: int) -> None:
        """Select ``low .. high``; runs that touch it become one with it."""
        i, j = bisect_left(self.ends, low - 1), bisect_right(self.starts, high + 1)
        if i < j:
            low, high = min(low, self.starts[i]), max(high, self.ends[j - 1])
        self.starts[i:j], self.ends[i:j] = [low], [high]

    def remove(self, low: int, high: int) -> None:
        """Deselect ``low .. high``; what stands out on either side stays."""
        if low > high:
            return
        i, j = bisect_left(self.ends, low), bisect_right(self.starts, high)
        if i >= j:
            return
        first, last = self.starts[i], self.ends[j - 1]
        left = [(first, low - 1)] if first < low else []
        right = [(high + 1, last)] if last > high else []
        kept = left + right
        self.starts[i:j], self.ends[i:j] = [x for x, _ in kept], [y for _, y in kept]


def apply_event(selected: Runs, op: str, start: int, end: int | None) -> None:
    """Change a selection by one event.

    ``select``/``deselect`` add or remove a range. ``click`` adds a word, removes a
    lone one, and inside a block drops the rest of the block. ``drag`` adds its range,
    or, begun on a selected word, removes it within the block of that word.
    """
    block = selected.run_of(start)
    if op == "click":
        if block is None:
            selected.add(start, start)
        elif block[0] == block[1]:
            selected.remove(start, start)
        else:
            selected.remove(start + 1, block[1])
        return
    end = start if end is None else end
    low, high = min(start, end), max(start, end)
    if op == "select" or (op == "drag" and start != end and block is None):
        selected.add(low, high)
    elif op == "deselect":
        selected.remove(low, high)
    elif op == "drag" and start != end:
        selected.remove(max(low, block[0]), min(high, block[1]))


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by clip and seq; keeps one selection at a time, never the events."""
    clip, selected, clip_type = None, Runs(), None

    def rows(clips: list, starts: list[int], ends: list[int]) -> pa.RecordBatch:
        columns = [pa.array(clips, clip_type), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())]
        return pa.RecordBatch.from_arrays(columns, ["clip_id", "start_index", "end_index"])

    for batch in batches:
        clip_type = batch.schema.field("clip_id").type
        clips, starts, ends = [], [], []
        fields = ("clip_id", "op", "from_index", "to_index")
        for row_clip, op, start, stop in zip(*(batch.column(f).to_pylist() for f in fields)):
            if row_clip != clip:
                clips += [clip] * len(selected.starts)
                starts += selected.starts
                ends += selected.ends
                clip, selected = row_clip, Runs()
            apply_event(selected, op, start, stop)
        yield rows(clips, starts, ends)
    if selected.starts:
        yield rows([clip] * len(selected.starts), selected.starts, selected.ends)


def fold_intervals(events: DataFrame) -> DataFrame:
    """``(clip_id, start_index, end_index)`` of each selected run after all events of a clip.

    What a click or drag does depends on the selection before it, so the events of a
    clip run in ``seq`` order; the state is the clip's selected runs.
    """
    clip_type = events.schema["clip_id"].dataType.simpleString()
    return (
        events.select("clip_id", "seq", "op", "from_index", "to_index")
        .repartition("clip_id")
        .sortWithinPartitions("clip_id", "seq")
        .mapInArrow(_fold, f"clip_id {clip_type}, start_index int, end_index int")
    )


def words_of(intervals: DataFrame) -> DataFrame:
    """``(clip_id, word_index)`` for every index of the intervals."""
    every = F.explode(F.sequence("start_index", "end_index"))
    return intervals.select("clip_id", every.alias("word_index"))


def fold_events(events: DataFrame) -> DataFrame:
    """``(clip_id, word_index)`` after all events of each clip in ``seq`` order."""
    return words_of(fold_intervals(events))


def latest_intervals(events: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    """Selected runs ``(clip_id, start_index, end_index)`` of ``select``/``deselect`` logs.

    The last event on a word counts, so no order within the clip is needed. The ends of
    a clip's ranges cut its indexes into stretches, numbered from left to right. A range
    covers a row of stretches; it is written as the few aligned blocks of 1, 2, 4 ...
    stretches that make up this row, the latest event of each block is a partial
    aggregate, and the latest event on a stretch is the latest of the blocks it lies in.
    So a range costs the same for ten words and for a billion, and a clip with a third
    of all events is spread over its blocks. Large blocks meet whole chunks of stretches
    first, as they would meet too many single ones. Of events with equal ``seq`` on one
    word a ``select`` counts. Events without a clip or a first index select nothing.
    """
    chunk = max(1, (limits.running_chunk - 1).bit_length())
    ranges = events.where("clip_id IS NOT NULL AND from_index IS NOT NULL").select(
        F.col("clip_id").alias("_clip"),
        F.least("from_index", F.coalesce("to_index", "from_index")).cast("long").alias("_low"),
        (F.greatest("from_index", F.coalesce("to_index", "from_index")).cast("long") + 1).alias("_high"),
        F.struct("seq", (F.col("op") == "select").alias("on")).alias("_latest"),
    )
    end = F.explode(F.array("_low", "_high"))
    ends = cut(
        rank_in_group(
            ranges.select("_clip", end.alias("_index")).distinct(), "_clip", [F.col("_index")], "_nth"
        ).select("_clip", "_index", F.col("_nth").cast("long").alias("_place"))
    )
    blocks = (
        ranges.groupBy("_clip", "_low", "_high").agg(F.max("_latest").alias("_latest"))
        .join(shuffled(ends.withColumnsRenamed({"_index": "_low", "_place": "_a"})), ["_clip", "_low"])
        .join(shuffled(ends.withColumnsRenamed({"_index": "_high", "_place": "_b"})), ["_clip", "_high"])
        .select("_clip", "_latest", F.explode(_blocks("_a", "_b")).alias("_block"))
        .groupBy("_clip", "_block.level", "_block.number").agg(F.max("_latest").alias("_latest"))
    )
    blocks = cut(blocks)
    chunks = ends.select("_clip", F.shiftright("_place", chunk).alias("_chunk")).distinct()
    # Places are ints, so no block is above level 31.
    wide = (
        chunks.select("_clip", "_chunk", F.explode(F.sequence(F.lit(chunk), F.lit(31))).alias("level"))
        .withColumn("number", F.expr(f"shiftright(_chunk, level - {chunk})"))
        .join(shuffled(blocks.where(F.col("level") >= chunk)), ["_clip", "level", "number"])
        .groupBy("_clip", "_chunk").agg(F.max("_latest").alias("_wide"))
    )
    level = F.explode(F.sequence(F.lit(0), F.lit(chunk - 1)))
    near = (
        ends.select("_clip", "_place", level.alias("level"))
        .withColumn("number", F.expr("shiftright(_place, level)"))
        .join(shuffled(blocks.where(F.col("level") < chunk)), ["_clip", "level", "number"])
        .groupBy("_clip", "_place").agg(F.max("_latest").alias("_near"))
    )
    latest = F.greatest("_near", "_wide")
    stretches = cut(
        ends.join(shuffled(near), ["_clip", "_place"], "left")
        .withColumn("_chunk", F.shiftright("_place", chunk))
        .join(shuffled(wide), ["_clip", "_chunk"], "left")
        .select("_clip", "_place", "_index", F.coalesce(latest["on"], F.lit(False)).alias("_on"))
    )
    size = limits.running_chunk
    before = previous_value(stretches, "_clip", "_place", "_on", "_before", size)
    turns = before.where(F.col("_on") != F.coalesce("_before", F.lit(False)))
    kind = events.schema["from_index"].dataType
    return (
        previous_value(turns, "_clip", "_place", "_index", "_start", size)
        .where(~F.col("_on"))
        .select(
            F.col("_clip").alias("clip_id"),
            F.col("_start").cast(kind).alias("start_index"),
            (F.col("_index") - 1).cast(kind).alias("end_index"),
        )
    )


def _blocks(first: str, stop: str) -> Column:
    """Aligned blocks (level, number) of 2^level places that make up ``first .. stop - 1``.

    On each level a block is taken on the left if the rest begins at an odd number, and
    on the right if it stops at one; what is left goes up a level.
    """
    return F.expr(f"""flatten(transform(
        sequence(0, cast(floor(log2({stop} - {first})) as int)),
        level -> filter(array(
            named_struct('level', level, 'number', shiftright({first} + shiftleft(1L, level) - 1, level), 'taken',
                shiftright({first} + shiftleft(1L, level) - 1, level) % 2 = 1),
            named_struct('level', level, 'number', shiftright({stop}, level) - 1, 'taken',
                shiftright({stop}, level) % 2 = 1)),
          b -> b.taken
            AND shiftright({first} + shiftleft(1L, level) - 1, level) < shiftright({stop}, level))))""")


def latest_ranges(events: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    """``(clip_id, word_index)`` after a log of ``select``/``deselect`` only."""
    return words_of(latest_intervals(events, limits))


def latest_words(events: DataFrame, words: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    """The rows of ``words`` (clip_id, word_index, ...) that such a log selects.

    Every word takes the last interval that starts at or before it: intervals and words
    are put in one sequence, so an interval of any length is one row.
    """
    found = latest_intervals(events, limits)
    rows = words.columns
    starts = found.select(
        "clip_id", F.col("start_index").cast("long").alias("_at"), F.col("end_index").alias("_end"),
    )
    asked = words.withColumn("_word", F.struct(*rows)).select(
        "clip_id", F.col("word_index").cast("long").alias("_at"), "_word"
    )
    marks = starts.unionByName(asked, allowMissingColumns=True)
    # Two rows for each index, the interval's first, so that the word takes it.
    marks = marks.withColumn("_order", F.col("_at") * 2 + F.col("_word").isNotNull().cast("long"))
    known = marks.withColumn("_chunk", F.floor(F.col("_order") / limits.running_chunk))
    lasts = known.groupBy("clip_id", "_chunk").agg(F.max("_end").alias("_last"))
    across = Window.partitionBy("clip_id").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.select("clip_id", "_chunk", F.max("_last").over(across).alias("_carried"))
    inside = Window.partitionBy("clip_id", "_chunk").orderBy("_order")
    reach = F.greatest(F.max("_end").over(inside), F.col("_carried"))
    return (
        known.join(shuffled(carried), ["clip_id", "_chunk"])
        .withColumn("_reach", reach)
        .where(F.col("_word").isNotNull() & (F.col("_reach") >= F.col("_at")))
        .select("_word.*")
    )


def selection_blocks(selections: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    """Runs of neighbouring selected words: ``(clip_id, block, start, end, size)``.

    Index minus number of selected words before it is constant inside a run.
    """
    return (
        with_block(selections, limits)
        .groupBy("clip_id", "block")
        .agg(
            F.min("word_index").alias("start_index"),
            F.max("word_index").alias("end_index"),
            F.count(F.lit(1)).alias("size"),
        )
    )


def with_block(selections: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    ones = selections.select("clip_id", "word_index").distinct().withColumn("one", F.lit(1))
    counted = running_total(
        ones, "clip_id", "word_index", "one", "before", limits.running_chunk
    )
    return counted.select(
        "clip_id", "word_index", (F.col("word_index") - F.col("before")).alias("block")
    )


def selection_edges(selections: DataFrame) -> DataFrame:
    """Mark the first and last selected word of each clip."""
    ends = selections.groupBy("clip_id").agg(
        F.min("word_index").alias("low"), F.max("word_index").alias("high")
    )
    edge = (F.col("word_index") == F.col("low")) | (F.col("word_index") == F.col("high"))
    return selections.join(shuffled(ends), "clip_id").select("clip_id", "word_index", edge.alias("is_edge"))


def lone_words(selections: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    """Selected words with no selected neighbour."""
    return (
        selection_blocks(selections, limits)
        .where(F.col("size") == 1)
        .select("clip_id", F.col("start_index").alias("word_index"))
    )
