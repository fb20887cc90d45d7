"""Clip requests to transcripts: feed address, window, timed words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueglass.config import DEFAULT, Limits
from cueglass.functions.text import non_empty
from cueglass.operators.scale import cut, shuffled
from cueglass.operators.transcript import add_window, slice_clips
from cueglass.sources.readers import audio_urls

# Where a transcript comes from, and why there is none.
SPOKEN, STAND_IN = "assemblyai", "mock"
NO_AUDIO, NO_TRANSCRIPT = "Audio URL not available", "AssemblyAI generation failed"


def clip_words(requests: DataFrame, words: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    """Timed words of each request with ``word_index`` counted from the clip's start."""
    window = add_window(requests).select("clip_id", "episode_id", "start_ms", "end_ms")
    inside = slice_clips(window, words, limits)
    starts = inside.groupBy("clip_id").agg(F.min("word_index").alias("_first"))
    return inside.join(starts, "clip_id").select(
        "clip_id",
        "episode_id",
        (F.col("word_index") - F.col("_first")).alias("word_index"),
        "text",
        F.col("word_start_ms").alias("start_ms"),
        F.col("word_end_ms").alias("end_ms"),
        *[c for c in ("confidence", "speaker") if c in words.columns],
    )


def clip_transcripts(
    requests: DataFrame,
    items: DataFrame,
    words: DataFrame,
    limits: Limits = DEFAULT,
) -> DataFrame:
    """One row per request with its text and source.

    Without an audio address or a timestamp there is no transcript: the row says
    ``mock`` and why. ``requests``: clip_id, podcast_id, episode_id, episode_title,
    timestamp, before_s, after_s. Requests for the same window share its words: each
    window is cut out and put together once.
    """
    urls = audio_urls(
        requests.select("podcast_id", F.col("episode_title").alias("term")), items, limits
    ).withColumnRenamed("term", "episode_title")
    windowed = cut(add_window(requests).join(shuffled(urls), ["podcast_id", "episode_title"], "left"))
    ready = windowed.where(
        F.col("audio_url").isNotNull() & non_empty(F.col("timestamp")).isNotNull()
    )
    # A clip id that comes twice has the words of both windows.
    window = F.struct("episode_id", "start_ms", "end_ms")
    asked = cut(ready.groupBy("clip_id").agg(F.sort_array(F.collect_list(window)).alias("windows")))
    once = asked.select("windows").distinct().select("windows", F.explode("windows").alias("w"))
    sliced = slice_clips(once.select("windows", "w.*"), words, limits)
    ordered = F.sort_array(F.collect_list(F.struct("word_index", "text", "confidence")))
    texts = sliced.groupBy("windows").agg(
        F.array_join(F.transform(ordered, lambda w: w.text), " ").alias("transcript"),
        F.avg("confidence").alias("confidence"),
        F.count(F.lit(1)).alias("word_count"),
    )
    has_text = F.col("transcript").isNotNull()
    # The long texts are joined last, so they are moved once for each window.
    found = windowed.join(shuffled(asked), "clip_id", "left").join(shuffled(texts), "windows", "left")
    return found.select(
        "clip_id",
        "podcast_id",
        "episode_id",
        "episode_title",
        "timestamp",
        "start_ms",
        "end_ms",
        "duration_ms",
        "audio_url",
        F.coalesce("transcript", F.lit("")).alias("transcript"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce("word_count", F.lit(0)).alias("word_count"),
        F.when(has_text, SPOKEN).otherwise(STAND_IN).alias("source"),
        F.when(has_text, None)
        .when(F.col("audio_url").isNull(), NO_AUDIO)
        .otherwise(NO_TRANSCRIPT)
        .alias("mock_reason"),
    )
