"""Transcripts: speaker text, word indexes, clip slices, word timings, corrections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueglass.config import DEFAULT, Limits
from cueglass.functions.text import non_empty
from cueglass.functions.timefmt import clip_window
from cueglass.operators.scale import previous_value, running_total, shuffled

TOKEN = r"(\S+)(\s*)"


def speaker_count(utterances: DataFrame) -> DataFrame:
    return utterances.groupBy("clip_id").agg(F.count_distinct("speaker").alias("speakers"))


def _with_breaks(utterances: DataFrame, limits: Limits) -> DataFrame:
    """Add ``piece``: the utterance behind its separator (two line breaks on a change of
    speaker, a space otherwise, nothing at the start)."""
    placed = previous_value(
        utterances.select("clip_id", "seq", F.coalesce("speaker", F.lit("")).alias("speaker"), "text"),
        "clip_id", "seq", "speaker", "before", limits.running_chunk,
    )
    gap = (
        F.when(F.col("before").isNull(), "")
        .when(F.col("before") == F.col("speaker"), " ")
        .otherwise("\n\n")
    )
    return placed.withColumn("piece", F.concat(gap, F.coalesce("text", F.lit(""))))


def _multi_speaker(utterances: DataFrame) -> DataFrame:
    named = F.coalesce("speaker", F.lit(""))
    return (
        utterances.groupBy("clip_id")
        .agg(F.min(named).alias("low"), F.max(named).alias("high"))
        .where(F.col("low") != F.col("high"))
        .select("clip_id")
    )


def speaker_text(utterances: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    """``(clip_id, text)``: one text per clip with a paragraph per change of speaker."""
    pieces = F.sort_array(F.collect_list(F.struct("seq", "piece")))
    return (
        _with_breaks(utterances, limits)
        .groupBy("clip_id")
        .agg(F.array_join(F.transform(pieces, lambda p: p.piece), "").alias("text"))
    )


def format_transcripts(
    transcripts: DataFrame, utterances: DataFrame, limits: Limits = DEFAULT
) -> DataFrame:
    """The plain text, replaced by speaker text where more than one speaker talks."""
    multi = utterances.join(_multi_speaker(utterances), "clip_id", "left_semi")
    spoken = speaker_text(multi, limits).withColumnRenamed("text", "spoken")
    return transcripts.join(spoken, "clip_id", "left").select(
        "clip_id", F.coalesce("spoken", "text").alias("text")
    )


def index_words(texts: DataFrame, key: str) -> DataFrame:
    """``(key, word_index, token, item)``: non-blank tokens of whole texts; ``item`` keeps
    the white space behind the token."""
    found = F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0))
    return texts.select(key, F.posexplode(found).alias("word_index", "item")).select(
        key, "word_index", F.regexp_extract("item", r"\S+", 0).alias("token"), "item"
    )


def index_utterance_words(utterances: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    """Word index of multi-speaker text without ever building that text.

    ``(clip_id, word_index, seq, pos, item)``. Each utterance is split on its own and
    starts at the number of words before it. White space in front of an utterance is
    an item of its own (``pos`` -1) that belongs to the word before.
    """
    pieces = _with_breaks(utterances, limits).select("clip_id", "seq", "piece")
    split = pieces.withColumn("items", F.regexp_extract_all("piece", F.lit(TOKEN), F.lit(0)))
    counted = running_total(
        split.withColumn("n", F.size("items")), "clip_id", "seq", "n", "base", limits.running_chunk
    )
    lead = F.struct(F.lit(-1).alias("pos"), F.regexp_extract("piece", r"^\s*", 0).alias("item"))
    words = F.transform("items", lambda x, i: F.struct(i.alias("pos"), x.alias("item")))
    return (
        counted.select(
            "clip_id", "seq", "base", F.explode(F.concat(F.array(lead), words)).alias("w")
        )
        .where(F.col("w.item") != "")
        .select(
            "clip_id", (F.col("base") + F.col("w.pos")).cast("int").alias("word_index"), "seq", "w.pos", "w.item"
        )
    )


def index_transcripts(
    transcripts: DataFrame, utterances: DataFrame, limits: Limits = DEFAULT
) -> DataFrame:
    """Word items of every clip: by utterance with several speakers, else by plain text."""
    multi = _multi_speaker(utterances)
    spoken = index_utterance_words(utterances.join(multi, "clip_id", "left_semi"), limits)
    plain = index_words(transcripts.join(multi, "clip_id", "left_anti"), "clip_id").select(
        "clip_id",
        "word_index",
        F.lit(0).cast(spoken.schema["seq"].dataType).alias("seq"),
        F.lit(0).alias("pos"),
        "item",
    )
    return spoken.unionByName(plain)


def slice_clips(clips: DataFrame, words: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    """Timed words of each clip window: start in [start_ms, end_ms).

    Both sides are cut into minutes, so a popular or very long episode is joined
    minute by minute instead of word by clip.
    """
    bucket = limits.range_bucket_ms
    spans = clips.where(F.col("end_ms") > F.col("start_ms")).withColumn(
        "_minute",
        F.explode(
            F.sequence(F.floor(F.col("start_ms") / bucket), F.floor((F.col("end_ms") - 1) / bucket))
        ),
    )
    timed = words.withColumnsRenamed({"start_ms": "word_start_ms", "end_ms": "word_end_ms"})
    timed = timed.withColumn("_minute", F.floor(F.col("word_start_ms") / bucket))
    inside = (F.col("word_start_ms") >= F.col("start_ms")) & (
        F.col("word_start_ms") < F.col("end_ms")
    )
    return spans.join(shuffled(timed), ["episode_id", "_minute"]).where(inside).drop("_minute")


def add_window(requests: DataFrame) -> DataFrame:
    """Add ``start_ms``, ``end_ms`` and ``duration_ms`` of each request."""
    window = clip_window(F.col("timestamp"), F.col("before_s"), F.col("after_s"))
    return requests.withColumn("_w", window).select(*requests.columns, "_w.*")


def align_timings(tokens: DataFrame, timings: DataFrame) -> DataFrame:
    """Display tokens with the timing row at the same place; null where there is none."""
    return tokens.join(
        shuffled(timings.select("clip_id", "word_index", "start_ms", "end_ms")),
        ["clip_id", "word_index"],
        "left",
    )


def alignment_counts(tokens: DataFrame, timings: DataFrame) -> DataFrame:
    """Both lengths per clip; a difference means that time ranges may be off."""
    a = tokens.groupBy("clip_id").agg(F.count(F.lit(1)).alias("token_count"))
    b = timings.groupBy("clip_id").agg(F.count(F.lit(1)).alias("timing_count"))
    return a.join(b, "clip_id", "full").select(
        "clip_id",
        F.coalesce("token_count", F.lit(0)).alias("token_count"),
        F.coalesce("timing_count", F.lit(0)).alias("timing_count"),
    )


def low_confidence_words(words: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    return words.where(F.col("confidence") < limits.low_confidence)


def display_text(transcripts: DataFrame) -> DataFrame:
    """The corrected text where there is one that differs from the original."""
    changed = F.col("corrected_text").isNotNull() & ~F.col("corrected_text").eqNullSafe(F.col("text"))
    return transcripts.withColumn(
        "display_text", F.when(changed, F.col("corrected_text")).otherwise(F.col("text"))
    )


def unpivot_improvements(corrections: DataFrame, key: str) -> DataFrame:
    """One row per kind of correction with a count above 0; ``none_needed`` if all are 0."""
    none = F.forall(F.map_values("improvements"), lambda n: n == 0)
    return corrections.select(
        key,
        none.alias("none_needed"),
        F.explode_outer(F.map_filter("improvements", lambda _, n: n > 0)).alias("kind", "count"),
    )


def correction_items(corrections: DataFrame, key: str) -> DataFrame:
    """One row per listed correction; ``raw`` holds a plain string or a JSON object."""
    parsed = F.from_json(
        F.when(F.col("raw").startswith("{"), F.col("raw")),
        "original string, corrected string, reason string, confidence double",
    )
    rows = corrections.select(key, F.posexplode("items").alias("pos", "raw")).withColumn("c", parsed)
    is_object = F.col("raw").startswith("{")
    usable = non_empty(F.col("c.original")).isNotNull()
    return rows.select(
        key,
        "pos",
        F.when(usable, F.col("c.original")).alias("original"),
        F.when(usable, F.col("c.corrected")).alias("corrected"),
        F.when(~is_object, F.col("raw"))
        .when(usable, F.col("c.reason"))
        .otherwise("Correction applied (details not available)")
        .alias("reason"),
        F.when(usable, F.col("c.confidence")).alias("confidence"),
    )
