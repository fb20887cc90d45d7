"""The registered queries: each runs one operator over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cueglass.functions import screen, text, timefmt
from cueglass.operators import catalog, edits, layout, pairs, selection, transcript
from cueglass.operators.scale import cut, first_by, free, top_per_group
from cueglass.plans import clips as clip_plans
from cueglass.plans import extract, quotes, resolve
from cueglass.sources import readers
from cueglass.workload import inputs
from cueglass.workload.inputs import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    QUERIES[build.__name__] = lambda spark, folder: build(Tables(spark, folder))
    return build


def six(value: Column | str) -> Column:
    return F.round(value, 6)


def known(name: str) -> Column:
    """A whole number without nulls: -1 stands for none."""
    return F.coalesce(name, F.lit(-1)).alias(name)


def joined(words: Column) -> Column:
    return F.array_join(words, " ")


# --- text -----------------------------------------------------------------------------


@query
def levenshtein_sim(t: Tables) -> DataFrame:
    return inputs.title_pairs(t).select(
        "a_id", "b_id", six(text.text_similarity(F.col("a"), F.col("b"))).alias("similarity")
    )


@query
def title_similarity(t: Tables) -> DataFrame:
    return inputs.title_pairs(t).select(
        "a_id",
        "b_id",
        six(text.title_similarity(F.col("a"), F.col("b"))).alias("similarity"),
        six(
            text.title_similarity(F.col("a"), inputs.noisy_title(F.col("b")))
        ).alias("noisy_similarity"),
    )


@query
def keyword_score(t: Tables) -> DataFrame:
    score = text.keyword_score(F.col("a"), text.plain_keywords(F.col("b")))
    return inputs.title_pairs(t).select(
        "a_id", "b_id", six(score).alias("score"),
        six(text.keyword_confidence(score)).alias("confidence"),
    )


@query
def matched_keywords(t: Tables) -> DataFrame:
    match = text.keyword_match(F.col("a"), text.ranked_keywords(F.col("b")))
    return inputs.title_pairs(t).withColumn("m", match).select(
        "a_id", "b_id", joined(F.col("m.matched")).alias("matched"), six("m.score").alias("score")
    )


@query
def match_tier(t: Tables) -> DataFrame:
    noisy = inputs.noisy_title(F.col("b"))
    return inputs.title_pairs(t).select(
        "a_id", "b_id",
        F.coalesce(text.match_tier(noisy, F.col("a")), F.lit(0)).alias("tier"),
        F.coalesce(text.match_tier(F.col("a"), noisy), F.lit(0)).alias("reverse_tier"),
    )


@query
def top_keywords(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", joined(text.ranked_keywords(F.col("text"))).alias("keywords"))


@query
def keywords_all(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", joined(text.plain_keywords(F.col("text"))).alias("keywords"))


@query
def clean_title(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.clean_title(F.col("text")).alias("cleaned"))


@query
def middle_words(t: Tables) -> DataFrame:
    return t.documents.select(
        "doc_id", F.coalesce(text.middle_words(F.col("text")), F.lit("")).alias("middle")
    )


@query
def word_counts(t: Tables) -> DataFrame:
    cleaned = F.regexp_replace(F.lower("text"), r"[^\w\s]", " ")
    words = t.documents.select("doc_id", F.explode(text.split_words(cleaned)).alias("word"))
    return words.where("word <> ''").groupBy("doc_id", "word").count().withColumnRenamed("count", "n")


@query
def word_index(t: Tables) -> DataFrame:
    return transcript.index_words(t.documents, "doc_id").select(
        "doc_id", F.col("word_index").cast("bigint").alias("word_index"), "token"
    )


# --- catalog --------------------------------------------------------------------------


@query
def fuzzy_catalog_join(t: Tables) -> DataFrame:
    found = catalog.fuzzy_pairs(
        catalog.norm_texts(inputs.podcast_terms(t), "term"),
        catalog.norm_texts(inputs.podcasts(t), "title"),
        0.7,
    )
    return found.select("term", "title", six("similarity").alias("similarity"))


@query
def short_title_join(t: Tables) -> DataFrame:
    """All words against all lines of one or two, some of one letter, some without ASCII letters."""
    found = catalog.fuzzy_pairs(
        catalog.norm_texts(inputs.words(t), "word"),
        catalog.norm_texts(inputs.short_lines(t), "title"),
        0.7,
    )
    return found.select("term", "title", six("similarity").alias("similarity"))


@query
def podcast_match(t: Tables) -> DataFrame:
    found = catalog.match_podcasts(inputs.podcast_terms(t), inputs.podcasts(t))
    return found.select("term", "podcast_id", six("similarity").alias("similarity"))


@query
def podcast_search(t: Tables) -> DataFrame:
    found = catalog.search_podcasts(inputs.podcast_terms(t), inputs.podcasts(t))
    return found.select("term", "podcast_id", six("similarity").alias("similarity"), "rank")


@query
def podcast_suggestions(t: Tables) -> DataFrame:
    found = catalog.search_podcasts(inputs.podcast_terms(t), inputs.podcasts(t)).where("rank <= 3")
    ordered = F.sort_array(F.collect_list(F.struct("rank", "podcast_id")))
    ids = F.transform(ordered, lambda s: s.podcast_id.cast("string"))
    return found.groupBy("term").agg(joined(ids).alias("suggestions"))


def _episode_case(t: Tables) -> tuple[DataFrame, DataFrame]:
    episodes = cut(inputs.episodes(t))
    case = cut(inputs.episode_terms(t, episodes)), catalog.catalog_episodes(episodes)
    free(episodes)
    return case


@query
def episode_listing(t: Tables) -> DataFrame:
    listing = catalog.episode_listing(inputs.episodes(t))
    return listing.select("podcast_id", F.explode("listing").alias("e")).select(
        "podcast_id", "e.ord", "e.episode_id", "e.title"
    )


@query
def best_match(t: Tables) -> DataFrame:
    return catalog.best_match(*_episode_case(t)).select(
        "podcast_id", "term", "episode_id", six("similarity").alias("similarity")
    )


@query
def episode_match(t: Tables) -> DataFrame:
    return catalog.match_episodes(*_episode_case(t)).select(
        "podcast_id", "term", "episode_id", six("similarity").alias("similarity")
    )


@query
def episode_search_topk(t: Tables) -> DataFrame:
    return catalog.search_episodes(*_episode_case(t)).select(
        "podcast_id", "term", "episode_id", six("similarity").alias("similarity"), "rank"
    )


@query
def episode_rank(t: Tables) -> DataFrame:
    return catalog.rank_episodes(*_episode_case(t)).select(
        "podcast_id", "term", "episode_id", six("similarity").alias("similarity"), "rank"
    )


@query
def keyword_episode(t: Tables) -> DataFrame:
    return catalog.keyword_episode(*_episode_case(t)).select(
        "podcast_id", "term", "episode_id", six("confidence").alias("confidence")
    )


@query
def keyword_best_episode(t: Tables) -> DataFrame:
    return catalog.best_by_keywords(*_episode_case(t)).select(
        "podcast_id", "term", "episode_id", six("score").alias("score"),
        six("confidence").alias("confidence"),
    )


@query
def fuzzy_episode_match(t: Tables) -> DataFrame:
    return catalog.fuzzy_episodes(*_episode_case(t)).select(
        "podcast_id", "term", "episode_id", six("confidence").alias("confidence")
    )


@query
def fuzzy_podcast_match(t: Tables) -> DataFrame:
    found = resolve.Catalog(cut(inputs.podcasts(t)), inputs.episodes(t)).fuzzy_podcasts(inputs.text_pairs(t))
    return found.select(
        "podcast_text", "episode_text", "podcast_id", six("similarity").alias("similarity"),
        "episode_id", six("episode_confidence").alias("episode_confidence"),
    )


@query
def validate_pair(t: Tables) -> DataFrame:
    found = resolve.Catalog(cut(inputs.podcasts(t)), inputs.episodes(t)).validate(inputs.text_pairs(t))
    return found.select(
        "podcast_text", "episode_text", known("podcast_id"),
        six("podcast_confidence").alias("podcast_confidence"), known("episode_id"),
        six("episode_confidence").alias("episode_confidence"), "validated", "confidence",
    )


# --- layout ---------------------------------------------------------------------------


@query
def line_grouping(t: Tables) -> DataFrame:
    return layout.assign_lines(inputs.name_words(t).drop("line_key"))


@query
def line_rollup(t: Tables) -> DataFrame:
    return layout.roll_up_lines(inputs.name_words(t)).select(
        "image_id", "line_key", "text", F.col("avg_y").cast("double").alias("avg_y"),
        six("avg_x").alias("avg_x"), six("avg_area").alias("avg_area"), "word_count",
    )


@query
def position_filter_image(t: Tables) -> DataFrame:
    placed = layout.filter_by_image(inputs.lines(t).join(inputs.heights(t), "image_id"))
    return placed.select("image_id", "line_key", "tier", "part")


@query
def position_filter_content(t: Tables) -> DataFrame:
    return layout.filter_by_content(inputs.lines(t)).select("image_id", "line_key", "tier", "part")


@query
def candidate_valid(t: Tables) -> DataFrame:
    valid = screen.candidate_valid(F.col("text"), F.col("word_count"), F.col("avg_area"))
    return inputs.text_lines(t).select("kind", "id", "n", valid.alias("valid"))


@query
def date_like(t: Tables) -> DataFrame:
    low = text.trim_blank(F.lower("text"))
    return inputs.text_lines(t).select(
        "kind", "id", "n", screen.date_like(low).alias("is_date"), screen.is_time(low).alias("is_time")
    )


@query
def truncated_text(t: Tables) -> DataFrame:
    return inputs.text_lines(t).select(
        "kind", "id", "n", screen.truncated(text.trim_blank(F.col("text"))).alias("is_truncated")
    )


@query
def candidate_score(t: Tables) -> DataFrame:
    score = screen.candidate_score(F.col("text"), F.col("word_count"), F.col("avg_area"))
    return inputs.text_lines(t).select("kind", "id", "n", six(score).alias("score"))


@query
def top_candidates(t: Tables) -> DataFrame:
    lines = inputs.text_lines(t).select(
        F.concat("kind", F.lit(" "), "id").alias("image_id"), F.col("n").alias("line_key"),
        F.lit(0).alias("part"), "text", "avg_area", "word_count",
    )
    best = layout.rank_candidates(layout.score_lines(lines))
    return best.select("image_id", "ord", "line_key", "text", six("score").alias("score"))


@query
def union_dedupe(t: Tables) -> DataFrame:
    rows = inputs.lines(t).join(inputs.heights(t), "image_id")
    lower = rows.where("avg_y >= height * 0.45").withColumn("part", F.lit(0))
    upper = rows.where("avg_y < height * 0.45").withColumn("part", F.lit(1))
    both = lower.unionByName(upper).select("image_id", "text", "part", "line_key")
    return first_by(both, ["image_id", "text"], [F.col("part"), F.col("line_key")])


def _screen_candidates(t: Tables) -> DataFrame:
    scored = inputs.lines(t).withColumn("score", F.col("avg_area") / 1000)
    order = [F.desc("score"), F.col("line_key")]
    return top_per_group(scored, ["image_id"], order, 8).withColumnRenamed("rank", "ord")


@query
def spatial_pairs(t: Tables) -> DataFrame:
    return pairs.spatial_pairs(_screen_candidates(t)).select(
        "image_id", "top_ord", "bottom_ord", "distance", six("similarity").alias("similarity")
    )


@query
def pair_ranking(t: Tables) -> DataFrame:
    return pairs.rank_pairs(pairs.spatial_pairs(_screen_candidates(t))).select(
        "image_id", "top_ord", "bottom_ord", "pair_rank"
    )


@query
def nearest_vertical(t: Tables) -> DataFrame:
    return pairs.nearest_vertical(_screen_candidates(t)).select("image_id", "ord", "near_ord", "gap")


@query
def timestamp_extract(t: Tables) -> DataFrame:
    return layout.extract_timestamps(*inputs.time_screens(t))


@query
def text_context(t: Tables) -> DataFrame:
    _, texts = inputs.time_screens(t)
    near = text.text_context(F.col("full_text"), F.col("short"))
    return texts.select(
        "image_id", near.alias("context"), screen.clock_context(near).alias("is_clock")
    )


# --- times and ranges -----------------------------------------------------------------


@query
def parse_timestamp(t: Tables) -> DataFrame:
    return inputs.stamps(t).select(
        "event_id", timefmt.parse_timestamp(F.col("timestamp")).alias("seconds")
    )


@query
def format_timestamp(t: Tables) -> DataFrame:
    return inputs.stamps(t).select(
        "event_id", timefmt.format_timestamp(F.col("size") * 17).alias("shown"),
        timefmt.display_range(F.col("size") * 900, F.col("size") * 1900).alias("shown_range"),
    )


@query
def timeframe(t: Tables) -> DataFrame:
    c = F.col
    return inputs.stamps(t).select(
        "event_id",
        timefmt.timeframe(c("timestamp"), c("range_start"), c("range_end"), F.lit("stored")).alias("timeframe"),
    )


@query
def clip_window(t: Tables) -> DataFrame:
    asked = timefmt.api_range(F.col("range_start"), F.col("range_end"))
    rows = inputs.stamps(t).withColumn("r", asked).select("event_id", "timestamp", "r.*")
    return transcript.add_window(rows).select(
        "event_id", "before_s", "after_s", "start_ms", "end_ms", "duration_ms"
    )


@query
def snap_increment(t: Tables) -> DataFrame:
    return inputs.stamps(t).select(
        "event_id", timefmt.snap_increment(F.col("size") - 150).alias("snapped")
    )


@query
def clamp_range(t: Tables) -> DataFrame:
    moved = F.col("size") - 200
    return inputs.stamps(t).select(
        "event_id",
        timefmt.clamp_left(moved, F.col("range_end")).alias("range_left"),
        timefmt.clamp_right(moved, F.col("range_start")).alias("range_right"),
    )


@query
def deep_link(t: Tables) -> DataFrame:
    r = inputs.resolutions(t, "o_totalprice")
    start = F.when(F.col("o_totalprice") > 100000, F.floor("o_totalprice"))
    return r.select(
        "image_id", timefmt.deep_link(F.col("podcast_id"), F.col("episode_id"), start).alias("link")
    )


# --- transcripts ----------------------------------------------------------------------


@query
def speaker_count(t: Tables) -> DataFrame:
    return transcript.speaker_count(inputs.utterances(t))


@query
def speaker_transcript(t: Tables) -> DataFrame:
    return transcript.speaker_text(inputs.utterances(t))


@query
def positional_join(t: Tables) -> DataFrame:
    tokens = inputs.clip_items(t).where("pos >= 0")
    return transcript.align_timings(tokens, inputs.timings(t)).select(
        "clip_id", "word_index", F.regexp_extract("item", r"\S+", 0).alias("token"),
        known("start_ms"), known("end_ms"),
    )


@query
def alignment_counts(t: Tables) -> DataFrame:
    return transcript.alignment_counts(inputs.clip_items(t).where("pos >= 0"), inputs.timings(t))


@query
def clip_range_join(t: Tables) -> DataFrame:
    return clip_plans.clip_words(inputs.clips(t), inputs.timed_words(t)).select(
        "clip_id", "word_index", "text", "start_ms"
    )


@query
def selection_blocks(t: Tables) -> DataFrame:
    return quotes.block_texts(inputs.clip_items(t), inputs.selections(t)).select(
        "clip_id", "start_index", "end_index", "text"
    )


@query
def selection_edges(t: Tables) -> DataFrame:
    return selection.selection_edges(inputs.selections(t))


@query
def lone_words(t: Tables) -> DataFrame:
    return selection.lone_words(inputs.selections(t))


@query
def selection_latest(t: Tables) -> DataFrame:
    return selection.latest_ranges(inputs.range_events(t))


@query
def selection_intervals(t: Tables) -> DataFrame:
    return selection.latest_intervals(inputs.range_events(t))


@query
def selection_latest_words(t: Tables) -> DataFrame:
    """Words of the transcripts that the last select or deselect event on them selects."""
    words = inputs.timed_words(t).select(F.col("episode_id").alias("clip_id"), "word_index")
    return selection.latest_words(inputs.range_events(t), words)


@query
def selection_fold(t: Tables) -> DataFrame:
    return selection.fold_events(inputs.gesture_events(t))


@query
def low_confidence_words(t: Tables) -> DataFrame:
    return transcript.low_confidence_words(inputs.timed_words(t)).select(
        "episode_id", "word_index", "text", six("confidence").alias("confidence")
    )


@query
def clip_stats(t: Tables) -> DataFrame:
    per_clip = inputs.timed_words(t).groupBy(F.col("episode_id").alias("clip_id")).agg(
        F.max("end_ms").alias("end_ms"), F.min("start_ms").alias("start_ms"),
        F.count(F.lit(1)).alias("words"),
        F.count_if(F.col("confidence") < 0.8).alias("fixes"),
    )
    return per_clip.join(inputs.clips(t), "clip_id").select(
        "clip_id",
        timefmt.round_half_up((F.col("end_ms") - F.col("start_ms")) / 1000).alias("duration_s"),
        (F.col("before_s") + F.col("after_s")).alias("total_s"),
        "fixes",
        timefmt.percent(1 - F.col("fixes") / F.col("words")).alias("confidence_percent"),
    )


@query
def map_unpivot(t: Tables) -> DataFrame:
    rows = t.labels.select(
        "doc_id",
        F.create_map(F.lit("quality"), "quality", F.lit("toxic"), "toxic").alias("improvements"),
    )
    return transcript.unpivot_improvements(rows, "doc_id").select(
        "doc_id", "none_needed", F.coalesce("kind", F.lit("")).alias("kind"),
        F.coalesce("count", F.lit(0)).alias("count"),
    )


@query
def display_text(t: Tables) -> DataFrame:
    fixed = F.when(F.col("lang") != "en", F.regexp_replace("text", r"\s+", " "))
    rows = t.documents.select("doc_id", "text", fixed.alias("corrected_text"))
    return transcript.display_text(rows).select("doc_id", "display_text")


@query
def correction_items(t: Tables) -> DataFrame:
    as_object = F.to_json(
        F.struct(F.col("event_type").alias("original"), F.upper("event_type").alias("corrected"),
                 F.lit("case").alias("reason"))
    )
    items = F.array(as_object, F.col("event_type"), F.lit("{}"))
    return transcript.correction_items(t.events.select("event_id", items.alias("items")), "event_id")


# --- requests, edits, feeds -----------------------------------------------------------


@query
def upload_intake(t: Tables) -> DataFrame:
    return readers.accept_requests(inputs.files(t)).select(
        "request_id", "image_id", six("size_mb").alias("size_mb"), "is_large"
    )


@query
def status_counts(t: Tables) -> DataFrame:
    rows = t.documents.join(t.labels, "doc_id", "left").select(
        "source", F.when(F.col("quality").isNull(), "no label").alias("error")
    )
    return edits.status_counts(rows, "source")


@query
def coalesce_chain(t: Tables) -> DataFrame:
    r = inputs.resolutions(t)
    failed = F.col("podcast_title") == ""
    nth = F.concat(F.lit("Episode "), (F.col("image_id") % 5 + 1).cast("string"))
    return r.select(
        "image_id",
        edits.first_filled(
            F.col("episode_title"), F.col("podcast_title"), F.when(failed, "Extraction failed"), nth
        ).alias("title"),
        edits.first_filled(F.when(F.col("validated"), F.col("timestamp")), "0:00").alias("timestamp"),
    )


@query
def timestamp_options(t: Tables) -> DataFrame:
    short, long = inputs.clock_times()
    first = F.when(F.col("event_type") != "view", short)
    second = F.when(F.col("event_type") == "click", short).otherwise(long)
    root = F.when(F.col("event_type") == "error", "").otherwise(short)
    return t.events.select(
        "event_id", joined(edits.timestamp_options(first, second, root)).alias("options")
    )


@query
def override_join(t: Tables) -> DataFrame:
    return edits.apply_overrides(inputs.resolutions(t), inputs.overrides(t)).select(
        "image_id", known("podcast_id"), "podcast_title", known("episode_id"), "episode_title",
        "timestamp", "validated",
    )


@query
def delete_anti(t: Tables) -> DataFrame:
    return edits.drop_deleted(inputs.resolutions(t), inputs.overrides(t)).select("image_id", "timestamp")


@query
def transcript_eligible(t: Tables) -> DataFrame:
    return edits.eligible_for_transcript(inputs.resolutions(t)).select("image_id", "podcast_id")


@query
def podcast_details(t: Tables) -> DataFrame:
    small = F.when(F.col("p_size") % 3 != 0, F.concat(F.lit("s"), F.col("p_size")))
    large = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("l"), F.col("p_size"))).otherwise("")
    shows = t.part.select(
        F.col("p_partkey").alias("podcast_id"), inputs.part_title().alias("title"),
        F.col("p_brand").alias("artist"), F.lit(None).cast("string").alias("feed_url"),
        small.alias("artwork_100"), large.alias("artwork_600"),
        F.col("p_type").alias("description"), F.split("p_name", " ").alias("genres"),
    )
    ids = t.lineitem.select(F.col("l_suppkey").alias("podcast_id")).distinct()
    details = readers.podcast_details(ids, shows).select("podcast_id", "title", "artist", "artwork_url")
    listed = readers.listed_podcasts(ids, shows).select("podcast_id", F.col("artwork_url").alias("list_artwork_url"))
    return details.join(listed, "podcast_id")


@query
def first_match_above_threshold(t: Tables) -> DataFrame:
    episodes = cut(inputs.episodes(t))
    found = readers.first_similar_items(inputs.episode_terms(t, episodes), inputs.feed_items(t, episodes))
    free(episodes)
    return found.select("podcast_id", "term", F.col("pos").alias("episode_id"), "title")


@query
def feed_audio_url(t: Tables) -> DataFrame:
    episodes = cut(inputs.episodes(t))
    feeds = readers.feed_items(inputs.feed_xml(t, episodes))
    found = readers.audio_urls(inputs.episode_terms(t, episodes), feeds)
    free(episodes)
    return found


@query
def clip_transcript(t: Tables) -> DataFrame:
    """Each clip is asked for under every episode title of its podcast."""
    episodes = cut(inputs.episodes(t))
    asked = inputs.clips(t).withColumnRenamed("clip_id", "conv_id").join(
        inputs.episode_terms(t, episodes).select(
            F.col("podcast_id").alias("conv_id"), "podcast_id", F.col("term").alias("episode_title")
        ),
        "conv_id",
        "left",
    )
    asked = asked.withColumn("clip_id", F.concat_ws("/", "conv_id", "episode_title"))
    return clip_plans.clip_transcripts(asked, inputs.feed_items(t, episodes), inputs.timed_words(t)).select(
        "clip_id", known("podcast_id"), "start_ms", "end_ms", "audio_url", "transcript",
        six("confidence").alias("confidence"), "word_count", "source", "mock_reason",
    )


@query
def quote_export(t: Tables) -> DataFrame:
    k = F.col("clip_id")
    named = inputs.clips(t).select(
        "clip_id",
        F.concat(F.lit("Talk "), k.cast("string")).alias("episode_title"),
        F.when(k % 4 != 0, F.concat(F.lit("Show "), k.cast("string"))).alias("podcast_name"),
        F.when(k % 5 != 0, k + 1000).alias("podcast_id"),
        F.when(k % 3 != 0, k + 2000).alias("episode_id"),
        "timestamp",
        (-F.col("before_s")).alias("range_start"),
        F.col("after_s").alias("range_end"),
        F.lit("stored").alias("stored_label"),
    )
    return quotes.export_quotes(named, inputs.clip_items(t), inputs.selections(t), inputs.timings(t))


# --- whole pipeline -------------------------------------------------------------------


def _layout(t: Tables, once: bool = False) -> tuple[DataFrame, DataFrame, extract.Extraction]:
    """Words that are read ``once`` are not stored."""
    words = inputs.player_words(t)
    words = words if once else cut(words)
    screens, texts = inputs.player_screens(t), inputs.player_texts(words)
    return screens, texts, extract.extract_layout(screens, words, texts)


@query
def extract_candidates(t: Tables) -> DataFrame:
    _, _, found = _layout(t, once=True)
    return found.candidates.select("image_id", "ord", "text", "avg_y", six("score").alias("score"))


@query
def resolve_image(t: Tables) -> DataFrame:
    screens, _, found = _layout(t)
    resolved = resolve.resolve_images(
        screens.select("image_id"), found.candidates, cut(inputs.podcasts(t)), inputs.episodes(t)
    )
    return resolved.withColumns(
        {
            **{c: six(c) for c in ("podcast_confidence", "episode_confidence", "confidence")},
            **{c: known(c) for c in ("podcast_id", "episode_id")},
        }
    )


@query
def resolution_methods(t: Tables) -> DataFrame:
    """How many images each way of resolving settles."""
    return resolve_image(t).groupBy("method", "validated").agg(F.count(F.lit(1)).alias("images"))


@query
def extract_records(t: Tables) -> DataFrame:
    screens, texts, found = _layout(t)
    resolved = resolve.resolve_images(
        screens.select("image_id"), found.candidates, cut(inputs.podcasts(t)), inputs.episodes(t)
    )
    records = resolve.extraction_records(
        screens, texts, found.timestamps, extract.candidate_lists(found.candidates), resolved
    )
    return records.select(
        "image_id", "podcast_title", "episode_title", "timestamp", "player",
        six("confidence").alias("confidence"), "method", "validated",
        joined(F.transform("candidates", lambda c: c.text)).alias("candidates"), "raw_text", "error",
    )
