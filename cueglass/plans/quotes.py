"""Selected words to attributed quotes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueglass.config import DEFAULT, Limits
from cueglass.functions.text import trim_blank
from cueglass.functions.timefmt import deep_link, timeframe, word_timerange
from cueglass.operators.edits import first_filled
from cueglass.operators.scale import shuffled
from cueglass.operators.selection import with_block


def block_texts(items: DataFrame, selections: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    """``(clip_id, block, start_index, end_index, text)`` of each selected run of words.

    ``items`` are the word items of :func:`index_transcripts`; white space inside a
    block stays as it is. Selected indexes without a word do not count.
    """
    words = items.where(F.col("pos") >= 0).select("clip_id", "word_index")
    real = selections.join(shuffled(words), ["clip_id", "word_index"], "left_semi")
    placed = items.join(shuffled(with_block(real, limits)), ["clip_id", "word_index"])
    pieces = F.sort_array(F.collect_list(F.struct("word_index", "seq", "pos", "item")))
    return placed.groupBy("clip_id", "block").agg(
        F.min("word_index").alias("start_index"),
        F.max("word_index").alias("end_index"),
        trim_blank(F.array_join(F.transform(pieces, lambda p: p.item), "")).alias("text"),
    )


def export_quotes(
    clips: DataFrame,
    items: DataFrame,
    selections: DataFrame,
    timings: DataFrame,
    limits: Limits = DEFAULT,
) -> DataFrame:
    """``(clip_id, quote)``: title with time range, podcast, link, selected blocks.

    ``clips``: clip_id, episode_title, podcast_name, podcast_id, episode_id, timestamp,
    range_start, range_end, stored_label. Clips without a selection are left out. The
    range comes from the timing rows at the places of the first and last selected
    word; if either is missing, from the request.
    """
    blocks = block_texts(items, selections, limits)
    ordered = F.sort_array(F.collect_list(F.struct("start_index", "text")))
    chosen = blocks.groupBy("clip_id").agg(
        F.min("start_index").alias("first_word"),
        F.max("end_index").alias("last_word"),
        F.array_join(F.transform(ordered, lambda b: b.text), "\n\n").alias("body"),
    )
    starts = timings.select(
        "clip_id", F.col("word_index").alias("first_word"), F.col("start_ms").alias("first_ms")
    )
    ends = timings.select(
        "clip_id", F.col("word_index").alias("last_word"), F.col("end_ms").alias("last_ms")
    )
    timed = chosen.join(shuffled(starts), ["clip_id", "first_word"], "left").join(
        shuffled(ends), ["clip_id", "last_word"], "left"
    )
    requested = timeframe(
        F.col("timestamp"), F.col("range_start"), F.col("range_end"), F.col("stored_label")
    )
    spoken = word_timerange(F.col("first_ms"), F.col("last_ms"))
    quote = F.concat(
        F.col("episode_title"), F.lit(" ("), F.coalesce(spoken, requested), F.lit(")\n"),
        first_filled(F.col("podcast_name"), "Unknown Podcast"), F.lit("\n"),
        deep_link(F.col("podcast_id"), F.col("episode_id"), F.col("first_ms")), F.lit("\n\n"),
        F.col("body"),
    )
    return clips.join(shuffled(timed), "clip_id").select("clip_id", quote.alias("quote"))


def export_requests(quotes: DataFrame) -> DataFrame:
    """``(request_id, text)``: the quotes of a request (at most five files) in file
    order, two blank lines between them. ``quotes`` has request_id and file_index."""
    ordered = F.sort_array(F.collect_list(F.struct("file_index", "quote")))
    return quotes.groupBy("request_id").agg(
        F.array_join(F.transform(ordered, lambda q: q.quote), "\n\n\n").alias("text")
    )
