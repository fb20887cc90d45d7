"""Playback positions, ranges and links as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cueglass.config import DEFAULT
from cueglass.functions.text import bind, non_empty

# Fixed value: the public web address that links are built on.
LINK_BASE = "https://podcasts.apple.com/podcast/id"


def parse_timestamp(text: Column) -> Column:
    """Seconds of ``M:S`` or ``H:M:S``; anything else is 0."""

    def seconds(p: Column) -> Column:
        part = lambda i: F.get(p, F.lit(i)).try_cast("bigint")
        return (
            F.when(F.size(p) == 2, part(0) * 60 + part(1))
            .when(F.size(p) == 3, part(0) * 3600 + part(1) * 60 + part(2))
        )

    return F.coalesce(bind(F.split(text, ":"), seconds), F.lit(0).cast("bigint"))


def format_timestamp(seconds: Column) -> Column:
    """``M:SS`` with unbounded minutes."""
    s = seconds.cast("bigint")
    return F.concat(
        F.floor(s / 60).cast("string"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0")
    )


def timeframe(timestamp: Column, start: Column, end: Column, stored: Column) -> Column:
    """Range around a position; the stored label when position or range is missing."""
    at = parse_timestamp(timestamp)
    first = F.greatest(F.lit(0).cast("bigint"), at + start)
    last = F.greatest(first, at + end)
    known = non_empty(timestamp).isNotNull() & start.isNotNull() & end.isNotNull()
    return F.when(
        known, F.concat(format_timestamp(first), F.lit("-"), format_timestamp(last))
    ).otherwise(stored)


def clip_window(timestamp: Column, before_s: Column, after_s: Column) -> Column:
    """Struct of ``start_ms``, ``end_ms`` and ``duration_ms``."""

    def window(at: Column) -> Column:
        start = F.greatest(F.lit(0).cast("bigint"), (at - before_s) * 1000)
        end = ((at + after_s) * 1000).cast("bigint")
        return F.struct(
            start.alias("start_ms"), end.alias("end_ms"), (end - start).alias("duration_ms")
        )

    return bind(parse_timestamp(timestamp), window)


def api_range(start: Column, end: Column) -> Column:
    """Screen range (start at or below 0) to request range."""
    return F.struct(F.abs(start).alias("before_s"), end.alias("after_s"))


def word_timerange(first_start_ms: Column, last_end_ms: Column) -> Column:
    return F.concat(
        format_timestamp(F.floor(first_start_ms / 1000)),
        F.lit("-"),
        format_timestamp(F.ceil(last_end_ms / 1000)),
    )


def display_range(start_ms: Column, end_ms: Column) -> Column:
    return F.concat(
        format_timestamp(F.floor(start_ms / 1000)),
        F.lit(" - "),
        format_timestamp(F.floor(end_ms / 1000)),
    )


def deep_link(podcast_id: Column, episode_id: Column, start_ms: Column) -> Column:
    """Link to the show, the episode and the second, as far as each is known."""
    at = F.greatest(F.lit(0).cast("bigint"), F.floor(start_ms / 1000))
    show = F.concat(F.lit(LINK_BASE), podcast_id.cast("string"))
    episode = F.concat(show, F.lit("?i="), episode_id.cast("string"))
    return (
        F.when(podcast_id.isNull(), F.lit(""))
        .when(episode_id.isNull(), show)
        .when(start_ms.isNull(), episode)
        .otherwise(F.concat(episode, F.lit("&t="), at.cast("string")))
    )


def snap_increment(seconds: Column, steps: tuple[int, ...] = DEFAULT.snap_seconds) -> Column:
    """Nearest step, sign kept, ties to the smaller step; 0 stays 0."""
    size = F.abs(seconds)
    options = F.array(*[F.struct(F.abs(size - s).alias("gap"), F.lit(s).alias("step")) for s in steps])
    return F.when(seconds == 0, F.lit(0)).otherwise(
        F.array_min(options).step * F.signum(seconds).cast("int")
    )


def clamp_left(seconds: Column, end: Column, reach: int = DEFAULT.max_range_seconds) -> Column:
    return F.least(F.least(F.lit(0), F.greatest(F.lit(-reach), seconds)), end)


def clamp_right(seconds: Column, start: Column, reach: int = DEFAULT.max_range_seconds) -> Column:
    return F.greatest(F.greatest(F.lit(0), F.least(F.lit(reach), seconds)), start)


def round_half_up(value: Column) -> Column:
    return F.floor(value + 0.5)


def percent(confidence: Column) -> Column:
    return round_half_up(F.coalesce(confidence, F.lit(0.0)) * 100)


def file_size_mb(length: Column) -> Column:
    return F.round(length / 1048576, 2)
